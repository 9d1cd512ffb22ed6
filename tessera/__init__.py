"""tessera — text-corpus preparation and analysis as Spark DataFrame jobs.

Layout:
  functions/  pure Column -> Column expressions (normalisers, digests, byte maps, arrays, JSON)
  operators/  DataFrame -> DataFrame jobs (dedupe, filters, ordering, BPE, shards, windows, ...)
  sources/    scans and sinks (tables, text files, token shard files, manifests)
  plans/      job composition (corpus build, diagnosis report) and the query registry
  streaming/  Structured Streaming variants (capped ingest, online dedupe, rate limits, ...)
"""

from tessera.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
