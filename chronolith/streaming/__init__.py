"""Structured Streaming forms of the operators."""

from chronolith.streaming.streams import Bollinger, Ema, Macd, Rsi, Sma, file_stream, run_to_table, stream_bars, stream_indicator, stream_indicators, upsert_sink

__all__ = ["Bollinger", "Ema", "Macd", "Rsi", "Sma", "file_stream", "run_to_table", "stream_bars", "stream_indicator", "stream_indicators", "upsert_sink"]
