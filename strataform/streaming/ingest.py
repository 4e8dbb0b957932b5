"""Chunks and samples of corpora from a stream of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataform.config import Chunking
from strataform.operators import sampling
from strataform.operators.chunking import chunk
from strataform.plans.analyses import Settings, picked_chunks


def chunk_stream(docs: DataFrame, target: str, checkpoint: str, rule: Chunking = Chunking(per_corpus=None)) -> StreamingQuery:
    """Append the chunks of arriving documents (label, doc_id, text) as Parquet; stateless, so any number of files a
    trigger, and exactly once through the sink's log."""
    out = chunk(docs, rule)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def chosen(docs: DataFrame, s: Settings) -> DataFrame:
    """(label, doc_id, text, source_document_index): the documents of a stream that a corpus's budget or sample takes, as they arrive.

    State holds a corpus's count of documents with text and, for a reservoir, the digests of its sample (16 bytes each), so
    that it doesn't grow with the stream. Of a trigger's documents, in the order of their ids, only as many are held as the budget
    still wants. A reservoir passes on what is among its least digests when it comes; later ones may displace it, which
    ``finished_chunks`` settles (about ``reservoir`` x ln(scanned / reservoir) more than the sample).
    """
    prefix = s.sampling == "prefix"
    end = max(s.documents, s.skip + 1) if prefix else s.skip + max(s.scan or s.documents, 1)
    size = s.reservoir or max(s.documents, 4 * s.chunks)
    columns = ["label", "doc_id", "text", "source_document_index"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, known = state.get if state.exists else (0, b"")
        wanted, held = end - seen, None
        for f in frames:
            if wanted > 0:
                held = f if held is None else pd.concat([held, f])
                held = held.sort_values("doc_id", kind="stable", na_position="first").head(wanted)
        if held is None:
            return
        held = held.assign(source_document_index=range(seen, seen + len(held)))
        seen += len(held)
        held = held[held["source_document_index"] >= s.skip]
        if not prefix:
            digest = lambda i: hashlib.md5(f"{s.seed}|{key[0]}|{i}".encode()).digest()
            digests = [digest(i) for i in held["doc_id"]]
            least = sorted([known[i : i + 16] for i in range(0, len(known), 16)] + digests)[:size]
            stays = set(least)
            held = held.assign(source_document_index=held["source_document_index"] - s.skip)[[d in stays for d in digests]]
            known = b"".join(least)
        state.update((seen, known))
        yield held[columns]

    rows = sampling.with_text(docs).filter("label IS NOT NULL").select("label", F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = dict(docs.dtypes)["label"]
    return rows.groupBy("label").applyInPandasWithState(run, f"label {kind}, doc_id long, text string, source_document_index long", "seen long, digests binary", "append", "NoTimeout")


def choose_stream(docs: DataFrame, s: Settings, target: str, checkpoint: str) -> StreamingQuery:
    """Append what ``chosen`` takes of all files that are there, trigger by trigger; a restart goes on where the last run ended."""
    return chosen(docs, s).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def finished_chunks(taken: DataFrame, s: Settings) -> DataFrame:
    """The chunks of what a stream took so far: those that ``analyses.corpus_chunks`` gives of all documents, if they came in the order
    of their ids."""
    if s.sampling == "prefix":
        return picked_chunks(taken.withColumn("document_sample_rank", F.lit(None).cast("long")), "source_document_index", s)
    return picked_chunks(sampling.reservoir(taken, s.reservoir or max(s.documents, 4 * s.chunks), s.seed), "document_sample_rank", s)
