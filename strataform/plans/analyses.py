"""Whole analyses over a panel of corpora.

A panel is (label, ord, role); chunks are (label, doc_id, chunk_in_document, chunk_index, text); vectors are
(label, vec_id, embedding), one a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.config import ALPHAS, CHUNK_CHARS, CLUSTER_ROUNDS, CLUSTER_SWEEP, CLUSTERS, MAX_CHUNKS, MAX_CHUNKS_PER_DOCUMENT, MAX_DOCUMENTS, METRICS, NEAR_CEILING, ORDERS, PROJECTIONS, SAMPLE_SEED, TOKENIZERS, VOCABULARIES, Chunking
from strataform.functions.text import strip
from strataform.operators import chunking, composed, compression, extract, frequent, lexical, pairs, replicates, resample, sampling, scorecard, semantic
from strataform.plans.held import held, release
from strataform.sources import readers, sinks


def documents(spark: SparkSession, spec: dict, base: str = ".") -> DataFrame:
    """(label, doc_id, text) of one corpus of a recipe, by its source type and extraction mode."""
    rows, field, mode = readers.source(spark, spec, base), spec.get("field") or "text", spec.get("mode") or "plain_text"
    if "row" in rows.columns and mode != "message_list_last_assistant":
        rows = rows.select("*", *(F.expr(f"try_variant_get(row, '$.{c}', '{t}')").alias(c) for c, t in {field: "string", "role": "string", "lang": "string", "deleted": "boolean"}.items()))
    elif "row" in rows.columns:
        rows = rows.withColumn(field, F.expr(f"try_variant_get(row, '$.{field}', 'array<struct<role string, content string>>')"))
    by_mode = {
        "plain_text": lambda: extract.plain(rows, field),
        "field_text": lambda: extract.plain(rows, field),
        "dolma_url_manifest": lambda: extract.plain(rows, field),
        "oasst_assistant_text": lambda: extract.role_language(rows, field),
        "message_list_last_assistant": lambda: extract.last_message(rows, field),
        "hh_rlhf_last_assistant": lambda: extract.transcript_replies(rows, field),
    }
    if mode not in by_mode:
        raise ValueError(f"unknown mode {mode!r}")
    out = by_mode[mode]()
    number = F.col("source_index") if "source_index" in out.columns else F.col("doc_id") if "doc_id" in out.columns else F.xxhash64("text")
    return out.select(F.lit(spec["label"]).alias("label"), number.alias("doc_id"), "text")


@dataclass(frozen=True)
class Settings:
    """How one corpus is sampled and cut; ``sampling``: prefix (in order) or reservoir (a seeded uniform sample in random order)."""

    documents: int = MAX_DOCUMENTS
    chunks: int = MAX_CHUNKS
    chars: int = CHUNK_CHARS
    per_document: int = MAX_CHUNKS_PER_DOCUMENT
    skip: int = 0
    sampling: str = "prefix"
    seed: int = SAMPLE_SEED
    scan: int | None = None
    reservoir: int | None = None
    short: bool = False

    @staticmethod
    def of(spec: dict, **given) -> Settings:
        """What is given, else what a recipe says, else the constants."""
        names = {
            "documents": "max_documents", "chunks": "max_chunks", "chars": "chunk_chars", "per_document": "max_chunks_per_source_document", "skip": "skip_nonempty_documents", "sampling": "sampling_mode",
            "seed": "sample_seed", "scan": "sample_scan_documents", "reservoir": "sample_reservoir_documents", "short": "allow_short",
        }
        said = {k: spec[n] for k, n in names.items() if spec.get(n) is not None}
        own = Settings(**said | {k: v for k, v in given.items() if v is not None})
        if own.sampling not in ("prefix", "reservoir"):
            raise ValueError(f"unknown sampling_mode {own.sampling!r}")
        return replace(own, scan=own.scan or own.documents, reservoir=own.reservoir or max(own.documents, 4 * own.chunks))


def corpus_chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """A corpus's chunks (label, doc_id, text) with their provenance, numbered by ``chunk_index`` within the budget.

    Ordinals of documents count those that aren't blank: skipped ones included in a prefix, only those behind them in a reservoir.
    """
    if s.sampling == "prefix":
        picked, order = sampling.prefix(docs, s.documents, s.skip).withColumn("document_sample_rank", F.lit(None).cast("long")), "source_document_index"
    else:
        picked, order = sampling.reservoir(sampling.scanned(docs, s.scan, s.skip), s.reservoir, s.seed), "document_sample_rank"
    return picked_chunks(picked, order, s)


def picked_chunks(picked: DataFrame, order: str, s: Settings) -> DataFrame:
    """``corpus_chunks`` of documents that are chosen already, in ``order``."""
    rule = Chunking(s.chars, s.per_document, s.chunks, s.documents)
    body = picked.withColumn("text", strip("text"))
    facts = body.select("label", "doc_id", "source_document_index", "document_sample_rank", F.sha2("text", 256).alias("source_text_sha256"), F.length("text").cast("long").alias("source_text_chars"), F.posexplode(chunking.windows(F.col("text"), rule)).alias("chunk_in_document", "c"))
    rows = facts.select("*", "c.char_start", "c.char_end", "c.text", F.sha2("c.text", 256).alias("chunk_sha256")).drop("c")
    return chunking.budget(rows, s.chunks, order)


def build_chunks(spark: SparkSession, recipe: str, out: str, base: str = ".", labels: list[str] | None = None, reservoir: bool | None = None, overwrite: bool = False, allow_short: bool = False, **given) -> None:
    """Chunks, provenance, settings and statistics of a recipe's corpora, as Parquet below ``out``.

    Every corpus has the settings of its own entry, of the recipe's defaults or the constants; ``given`` (fields of ``Settings``)
    overrule all. Chunks and provenance are joined by (label, chunk_index). A corpus that falls short of its chunks, unless
    it may, is an error before anything is written.
    """
    mode = None if reservoir is None else "reservoir" if reservoir else "prefix"
    made, docs, seen, asked = None, None, None, []
    for spec in (r.asDict() for r in readers.recipe(spark, recipe).orderBy("ord").collect()):
        if labels is None or spec["label"] in labels:
            s, rows = Settings.of(spec, sampling=mode, **given), documents(spark, spec, base)
            part, read = corpus_chunks(rows, s), readers.source(spark, spec, base).select(F.lit(spec["label"]).alias("label"))
            made, docs, seen = (part, rows, read) if made is None else (made.unionByName(part), docs.unionByName(rows), seen.unionByName(read))
            asked.append((spec["label"], s))
    if made is None:
        raise ValueError("the recipe has none of the labels")
    made = made.persist()
    try:
        n = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
        short = [label for label, s in asked if n.get(label, 0) < s.chunks and not (s.short or allow_short)]
        if short:
            raise ValueError(f"too few chunks: {', '.join(sorted(short))}")
        settings = spark.createDataFrame([(label, s.documents, s.chunks, s.chars, s.per_document, s.skip, s.sampling, s.seed, s.scan, s.reservoir) for label, s in asked], "label string, max_documents long, max_chunks long, chunk_chars int, max_chunks_per_source_document int, skip_nonempty_documents long, sampling_mode string, sample_seed long, sample_scan_documents long, sample_reservoir_documents long")
        sinks.write_new(made.select("label", "chunk_index", "doc_id", "chunk_in_document", "char_start", "char_end", "text"), f"{out}/chunks", overwrite)
        sinks.write_new(made.drop("text").join(F.broadcast(settings.select("label", "sampling_mode", "sample_seed")), "label"), f"{out}/provenance", overwrite)
        sinks.write_new(settings, f"{out}/settings", overwrite)
        whole = docs.groupBy("label").agg(F.count_if(F.coalesce(strip("text"), F.lit("")) != "").alias("source_documents_extracted"))
        known = seen.groupBy("label").agg(F.count("*").alias("source_rows_seen")).join(whole, "label", "left")
        kept = made.groupBy("label").agg(F.countDistinct("doc_id").alias("source_documents_with_chunks"), F.count("*").alias("chunk_count"))
        sinks.write_new(known.join(kept, "label", "left").fillna(0), f"{out}/statistics", overwrite)
    finally:
        made.unpersist()


def standalone(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, n_chunks, lzma_ratio, total_variance, top1_share, top5_share); the codec sees all chunks, ``MAX_CHUNKS`` a stream."""
    n = chunks.groupBy("label").agg(F.count("*").alias("n_chunks"))
    return n.join(compression.whole_ratios(chunks, ("lzma",), MAX_CHUNKS), "label").join(semantic.spectrum(vectors).drop("n"), "label", "left")


def mismatched(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Corpora whose chunks and vectors differ in number (they are joined by place, so this must be empty)."""
    a, b = chunks.groupBy("label").agg(F.count("*").alias("chunks")), vectors.groupBy("label").agg(F.count("*").alias("vectors"))
    return a.join(b, "label", "full").filter(~F.col("chunks").eqNullSafe(F.col("vectors")))


def pair_metrics(panel: DataFrame, chunks: DataFrame, vectors: DataFrame, alone: DataFrame, k: int = CLUSTERS, tokenizers=("punct", "stable")) -> DataFrame:
    """(a, b, pair_class, direction, <six metrics>) of all ordered pairs; only lexical ones depend on the direction."""
    directed = pairs.directed(panel)
    counts = held(frequent.frequent_counts(chunks, 1024, tokenizers))
    words = lexical.lexical_pairs(lexical.cells(lexical.vocabulary(counts, 1024), counts, directed.select("a", "b")))
    clusters = semantic.occupancy_js(semantic.cluster_counts(vectors, pairs.unordered(panel), (k,), rounds=CLUSTER_ROUNDS), k, times="n")
    gaps = compression.gaps(alone.withColumnRenamed("lzma_ratio", "compression").withColumnsRenamed({"top1_share": "top1", "top5_share": "top5"}), directed, ["compression", "top1", "top5"])
    return pairs.attach(gaps.join(words, ["a", "b"], "left"), clusters, "semantic_cluster_js").select("a", "b", "pair_class", "direction", *METRICS)


def family(rows: DataFrame) -> DataFrame:
    """Means by pair class: each pair once (forward), lexical columns by ``directed_family``."""
    once = pairs.family_means(rows.filter("direction = 'forward'"), [m for m in METRICS if m not in ("lexical_js", "rho")])
    return once.join(pairs.directed_family(rows).drop("pairs"), "pair_class").select("pair_class", "pairs", *METRICS)


def corpus_matrix(panel: DataFrame, chunks: DataFrame, vectors: DataFrame, out: str) -> None:
    """Standalone values, pairs, families, directions and ordering checks as Parquet, and a report in Markdown."""
    bad = mismatched(chunks, vectors).limit(1).collect()
    if bad:
        raise ValueError(f"chunks and vectors of {bad[0].label} differ in number")
    spark = panel.sparkSession
    standalone(chunks, vectors).write.mode("overwrite").parquet(f"{out}/standalone")
    alone = spark.read.parquet(f"{out}/standalone")
    pair_metrics(panel, chunks, vectors, alone).write.mode("overwrite").parquet(f"{out}/pairs")
    rows = spark.read.parquet(f"{out}/pairs")
    family(rows).write.mode("overwrite").parquet(f"{out}/family")
    pairs.directions(rows).write.mode("overwrite").parquet(f"{out}/directions")
    pairs.separations(spark.read.parquet(f"{out}/family"), list(METRICS)).write.mode("overwrite").parquet(f"{out}/separations")
    pairs.checks(spark.read.parquet(f"{out}/family"), list(METRICS)).write.mode("overwrite").parquet(f"{out}/orderings")
    if "://" not in out:
        table = lambda name, *by: spark.read.parquet(f"{out}/{name}").orderBy(*by)
        Path(out, "summary.md").write_text(sinks.report("Corpus matrix", [f"corpora: `{panel.count()}`"], {"Families": table("family", "pair_class"), "Directions": table("directions", F.lit(1)), "Orderings": table("orderings", "metric"), "Separation": table("separations", "metric"), "Corpora": table("standalone", "label")}))


def bootstrap(panel: DataFrame, chunks: DataFrame, replicates_: int, checkpoint: str, seed: int = 0, batch: int = 10) -> DataFrame:
    """(replicate, pair_class, lexical_js, rho) of every replicate. Batches are appended to a checkpoint of JSON lines, and
    those that it holds aren't done again; a replicate depends on its number alone, so order and reruns don't matter."""
    spark = panel.sparkSession
    schema = "replicate long, pair_class string, lexical_js double, rho double"
    own, studied = held(chunks.join(F.broadcast(panel.select("label")), "label")), pairs.unordered(panel)
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    left = sorted(r.replicate for r in resample.pending(replicates_, readers.checkpoint(spark, checkpoint, schema).select("replicate").distinct()).collect())
    for i in range(0, len(left), batch):
        reps = spark.createDataFrame([(r, k) for k, r in enumerate(left[i : i + batch])], "replicate long, col int")
        draws = sampling.bootstrap_draws(sizes, reps.select("replicate"), seed).join(F.broadcast(reps), "replicate")
        wanted = studied.crossJoin(reps).select(F.struct("replicate", "pair_class").alias("id"), "a", F.col("col").alias("a_col"), "b", F.col("col").alias("b_col"))
        cells = replicates.composed_cells(own, replicates.drawn(draws, "col"), batch, wanted, (512,))
        rows = cells.groupBy("id.replicate", "id.pair_class").agg(F.avg("js").alias("lexical_js"), F.avg("rho").alias("rho"))
        sinks.append_json_lines(rows.select("replicate", "pair_class", "lexical_js", "rho"), checkpoint)
        release()
    return readers.checkpoint(spark, checkpoint, schema).filter(F.col("replicate") < replicates_)


def own_members(chunks: DataFrame) -> DataFrame:
    """Every corpus as composed of its own chunks, each once."""
    return chunks.select("label", F.col("label").alias("of"), "chunk_index", F.lit(1).cast("long").alias("times"))


def flagged(chunks: DataFrame) -> DataFrame:
    """(label, chunk_index, refuses, marked): patterns are looked for once a chunk."""
    return chunks.select("label", "chunk_index", F.col("text").rlike(extract.REFUSAL).alias("refuses"), F.col("text").rlike(extract.MARKER).alias("marked"))


def composed_alone(chunks: DataFrame, vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(label, n_chunks, lzma_ratio, total_variance, top1_share, top5_share, refusal_rate, marker_rate) of corpora composed of others' chunks.

    ``members`` (label, of, chunk_index, times) says of which corpus which chunk is in ``label``, and how often.
    """
    hit = lambda flag: F.sum(F.when(F.col(flag), F.col("times")).otherwise(0)) / F.sum("times")
    rates = flagged(chunks).withColumnRenamed("label", "of").join(members, ["of", "chunk_index"]).groupBy("label").agg(F.sum("times").alias("n_chunks"), hit("refuses").alias("refusal_rate"), hit("marked").alias("marker_rate"))
    rows = vectors.select(F.col("label").alias("of"), F.col("vec_id").alias("chunk_index"), "embedding").join(members, ["of", "chunk_index"])
    return rates.join(compression.composed_ratios(chunks, members, MAX_CHUNKS), "label").join(semantic.spectrum(rows, times="times").drop("n"), "label", "left")


def means_of_cells(cells: DataFrame, strict: bool = False) -> DataFrame:
    """(id, lexical_js, rho): means over a comparison's settings; an undefined agreement doesn't count, or with ``strict`` makes the mean NaN."""
    rho = F.when(F.count("rho") < F.count("*"), F.lit(float("nan"))).otherwise(F.avg("rho")) if strict else F.avg("rho")
    return cells.groupBy("id").agg(F.avg("js").alias("lexical_js"), rho.alias("rho"))


def column_pairs(chunks: DataFrame, vectors: DataFrame, cols: DataFrame, width: int, asked: DataFrame, words: DataFrame, partitions) -> DataFrame:
    """``asked`` (id, a, a_col, b, b_col, ...) with the six metrics of columns of corpora; ``words``: ``means_of_cells`` of the same comparisons.

    ``partitions(rows)`` gives [(a, b, centres)] and, for each, [(col, column of a, column of b)] that it counts for: the comparisons of ``a_col``
    col. ``width``: how many columns there are.
    """
    spark, kind = chunks.sparkSession, dict(chunks.dtypes)["label"]
    near = vectors.withColumn("chunk_index", F.col("vec_id")).withColumn("vec_id", F.xxhash64("label", "chunk_index"))
    rows = held(composed.dealt(near.join(cols, ["label", "chunk_index"])))
    heard = composed.ratios(chunks.select("label", "chunk_index", "text").join(cols, ["label", "chunk_index"]), width, MAX_CHUNKS)
    values = heard.join(composed.spectra(rows, width), ["label", "col"], "left")
    values = values.select(F.concat_ws("@", "label", "col").alias("label"), F.col("lzma_ratio").alias("compression"), F.col("top1_share").alias("top1"), F.col("top5_share").alias("top5"))
    fitted, wanted = partitions(rows)
    of = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(fitted)], f"i int, a_of {kind}, b_of {kind}")
    clusters = composed.occupancy_js(rows, width, fitted, wanted).join(F.broadcast(of), "i").withColumnRenamed("col", "a_col").drop("i")
    named = asked.withColumnsRenamed({"a": "a_of", "b": "b_of"}).withColumns({s: F.concat_ws("@", f"{s}_of", f"{s}_col") for s in "ab"})
    out = compression.gaps(values, named, ["compression", "top1", "top5"])
    return out.join(words, "id", "left").join(clusters, ["a_of", "b_of", "a_col"], "left")


def bootstrap_metrics(panel: DataFrame, chunks: DataFrame, vectors: DataFrame, replicates_: int, seed: int = 0, k: int = CLUSTERS, tokenizers=TOKENIZERS, orders=ORDERS, sizes=VOCABULARIES) -> DataFrame:
    """(replicate, a, b, pair_class, <six metrics>), in the order of replicates: chunks and vectors are drawn together with replacement,
    and clusters are fitted once a pair to the whole corpora. An undefined agreement makes the pair's NaN."""
    p, spark = pairs.unordered(panel), panel.sparkSession
    own = held(chunks.join(F.broadcast(panel.select("label")), "label"))
    reps = spark.range(replicates_).withColumnRenamed("id", "replicate")
    cols = held(replicates.packed(sampling.bootstrap_slots(own.groupBy("label").agg(F.count("*").alias("n")), reps, seed)))
    col = F.col("replicate").cast("int")
    asked = p.crossJoin(reps).select(F.struct("replicate", "a", "b").alias("id"), "replicate", "pair_class", "a", col.alias("a_col"), "b", col.alias("b_col"))
    cells = replicates.composed_cells(own, cols, replicates_, asked.select("id", "a", "a_col", "b", "b_col"), sizes, tokenizers, orders)

    def partitions(rows: DataFrame) -> tuple[list, list]:
        fitted = [f[1:] for f in semantic.fitted_centres(vectors, p, (k,), rounds=CLUSTER_ROUNDS)]
        return fitted, [[(r, r, r) for r in range(replicates_)]] * len(fitted)

    out = column_pairs(own, vectors, cols, replicates_, asked, means_of_cells(cells, strict=True), partitions)
    return out.select("replicate", F.col("a_of").alias("a"), F.col("b_of").alias("b"), "pair_class", *METRICS).orderBy("replicate", "a", "b")


def bootstrap_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quantiles over replicates of every metric's family means, and how often each ordering held."""
    family_ = rows.groupBy("replicate", "pair_class").agg(*(F.avg(m).alias(m) for m in METRICS))
    return resample.summary(family_, list(METRICS)), pairs.held_counts(pairs.checks(family_, list(METRICS), ("replicate",)))


def split_metrics(chunks: DataFrame, vectors: DataFrame, repeats: int, seed: int = 0, tokenizers=TOKENIZERS, orders=ORDERS, sizes=VOCABULARIES) -> DataFrame:
    """(label, repeat, <six metrics>) between the random halves of each corpus; ``resample.split_summary`` sums up."""
    reps, chunks = chunks.sparkSession.range(repeats).withColumnRenamed("id", "repeat"), held(chunks)
    cols, col = held(sampling.half_columns(chunks, repeats, seed)), (2 * F.col("repeat")).cast("int")
    asked = chunks.select("label").distinct().crossJoin(reps).select(F.struct("label", "repeat").alias("id"), "repeat", F.col("label").alias("a"), col.alias("a_col"), F.col("label").alias("b"), (col + 1).alias("b_col"))
    cells = replicates.composed_cells(chunks, cols, 2 * repeats, asked.select("id", "a", "a_col", "b", "b_col"), sizes, tokenizers, orders)
    names = [f"{r}@{half}" for r in range(repeats) for half in "AB"]

    def partitions(rows: DataFrame) -> tuple[list, list]:
        fitted = composed.half_centres(rows, 2 * repeats, names)
        return [(label, label, c) for label, _, c in fitted], [[(2 * g, 2 * g, 2 * g + 1)] for _, g, _ in fitted]

    out = column_pairs(chunks, vectors, cols, 2 * repeats, asked, means_of_cells(cells), partitions)
    return out.select(F.col("a_of").alias("label"), "repeat", *METRICS)


def mixture_panel(panel: DataFrame, chunks: DataFrame, vectors: DataFrame, alphas: tuple[float, ...] = ALPHAS, tokenizers=TOKENIZERS, orders=ORDERS, sizes=VOCABULARIES) -> DataFrame:
    """(base, target, alpha, rho, lexical_js, semantic_cluster_js, top1_share, top5_share, lzma_ratio, refusal_rate, marker_rate) of
    every targeted corpus's mixtures with every other; the unmixed one is pinned to divergence 0 and agreement 1.

    A corpus is cut into segments where any mixture's share ends. Grams, flags and moments are added up once a segment, and a
    mixture is the sum of two prefixes; only the codec and k-means have work for each mixture. The codec sees all chunks, streams
    that mixtures share once.
    """
    spark, targeted = panel.sparkSession, panel.filter("role = 'targeted'")
    own = held(chunks.join(F.broadcast(targeted.select("label")), "label"))
    plan = Mixtures.of(targeted, own, alphas)
    kind = dict(chunks.dtypes)["label"]
    wanted, cols = plan.frames(own)

    asked = wanted.filter("alpha > 0").select(F.struct("base", "target", "alpha").alias("id"), F.col("base").alias("a"), F.col("whole").alias("a_col"), F.col("base").alias("b"), F.col("base_col").alias("b_col"), F.col("target").alias("more"), F.col("target_col").alias("more_col"))
    cells = replicates.composed_cells(own, cols, plan.width, asked, sizes, tokenizers, orders, running=True)
    words = means_of_cells(cells).select("id.*", "lexical_js", "rho")

    sums = semantic.prefix_moments(vectors.withColumnRenamed("vec_id", "chunk_index").join(segment_of(cols), ["label", "chunk_index"]))
    met = mixed_sums(wanted, flagged(own).withColumns({c: F.col(c).cast("long") for c in ("refuses", "marked")}), cols, ["refuses", "marked"])
    rates = met.select("base", "target", "alpha", (F.col("refuses") / F.col("n")).alias("refusal_rate"), (F.col("marked") / F.col("n")).alias("marker_rate"))

    def spectra(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                parts = [(n, s, p) for n, s, p in ((r.base_n, r.base_s, r.base_p), (r.target_n, r.target_s, r.target_p)) if s is not None]
                if parts:
                    s = sum(np.frombuffer(x) for _, x, _ in parts)
                    p = sum(np.frombuffer(x) for _, _, x in parts).reshape(len(s), len(s))
                    out.append((r.base, r.target, r.alpha, *semantic.shares(int(sum(n for n, _, _ in parts)), s, p)[2:]))
            yield pd.DataFrame(out, columns=["base", "target", "alpha", "top1_share", "top5_share"])

    spread = both_sides(wanted, sums, ["n", "s", "p"]).select("base", "target", "alpha", *(f"{x}_{v}" for x in ("base", "target") for v in "nsp"))
    spectrum = spread.mapInPandas(spectra, f"base {kind}, target {kind}, alpha double, top1_share double, top5_share double")
    clusters = semantic.mixture_clusters(vectors.join(F.broadcast(targeted.select("label")), "label"), [m for m in plan.mixtures() if m[2] > 0])

    mixed = [(b, t, x, *((b, nb, t, nt) if b <= t else (t, nt, b, nb))) for b, t, x, nb, nt in plan.mixtures()]
    heard = compression.mixture_ratios(own, spark.createDataFrame(mixed, f"base {kind}, target {kind}, alpha double, first {kind}, n_first long, second {kind}, n_second long"), ["base", "target", "alpha"], MAX_CHUNKS)
    key = ["base", "target", "alpha"]
    out = wanted.join(heard, key).join(rates, key, "left").join(spectrum, key, "left").join(words, key, "left").join(clusters, key, "left")
    pinned = lambda m, v: F.when(F.col("alpha") == 0, F.lit(v)).otherwise(F.col(m)).alias(m)
    return out.select("base", "target", "alpha", pinned("rho", 1.0), pinned("lexical_js", 0.0), pinned("semantic_cluster_js", 0.0), "top1_share", "top5_share", "lzma_ratio", "refusal_rate", "marker_rate")


def segment_of(cols: DataFrame) -> DataFrame:
    """(label, chunk_index, col) of ``replicates.segments``."""
    return cols.select("label", "chunk_index", F.col("cols")[0].alias("col"))


def both_sides(wanted: DataFrame, prefixes: DataFrame, values: list[str]) -> DataFrame:
    """``wanted`` (``Mixtures.rows``) with the values of both prefixes (label, col, <values>): base_<value>, target_<value>; null of empty ones."""
    side = lambda s: prefixes.select(F.col("label").alias(s), F.col("col").alias(f"{s}_col"), *(F.col(v).alias(f"{s}_{v}") for v in values))
    return wanted.join(side("base"), ["base", "base_col"], "left").join(side("target"), ["target", "target_col"], "left")


def mixed_sums(wanted: DataFrame, rows: DataFrame, cols: DataFrame, values: list[str]) -> DataFrame:
    """``wanted`` with n, the chunks of each mixture, and the sums of ``values`` (whole numbers) over them: added up once a segment of ``rows``
    (label, chunk_index, <values>), then over prefixes."""
    up_to = Window.partitionBy("label").orderBy("col")  # a row a segment
    counted = rows.join(segment_of(cols), ["label", "chunk_index"]).groupBy("label", "col").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))
    prefixes = counted.select("label", "col", *(F.sum(v).over(up_to).alias(v) for v in ("n", *values)))
    total = lambda v: (F.coalesce(F.col(f"base_{v}"), F.lit(0)) + F.coalesce(F.col(f"target_{v}"), F.lit(0))).alias(v)
    return both_sides(wanted, prefixes, ["n", *values]).select(*wanted.columns, *map(total, ("n", *values)))


@dataclass(frozen=True)
class Mixtures:
    """Which mixtures there are of corpora of known sizes, and where they cut these. A row a corpus, pair or mixture: all small."""

    sizes: dict
    alphas: tuple[float, ...]

    @staticmethod
    def of(corpora: DataFrame, chunks: DataFrame, alphas: tuple[float, ...]) -> Mixtures:
        n = chunks.groupBy("label").agg(F.count("*").alias("n")).join(corpora.select("label", "ord"), "label").orderBy("ord").collect()
        return Mixtures({r.label: r.n for r in n}, alphas)

    def mixtures(self) -> list[tuple]:
        """(base, target, alpha, chunks of the base, of the target): shares of the base's size, rounded half to even, and
        no more of the target than there is."""
        out = []
        for base, n in self.sizes.items():
            for target, m in self.sizes.items():
                for alpha in self.alphas if base != target else ():
                    taken = max(0, min(n, round(n * alpha)))
                    out.append((base, target, alpha, n - taken, min(taken, m)))
        return out

    def cuts(self) -> dict:
        """{corpus: where its segments end}; the last end is its size."""
        ends: dict = {label: {n} for label, n in self.sizes.items()}
        for base, target, _, nb, nt in self.mixtures():
            ends[base].add(nb)
            ends[target].add(nt)
        return {label: sorted(e - {0}) for label, e in ends.items()}

    @property
    def width(self) -> int:
        return max((len(e) for e in self.cuts().values()), default=1)

    def ends(self) -> list[tuple]:
        return [(label, k, e) for label, cut in self.cuts().items() for k, e in enumerate(cut)]

    def frames(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` and the segments of ``chunks`` as frames."""
        spark, kind = chunks.sparkSession, dict(chunks.dtypes)["label"]
        wanted = spark.createDataFrame(self.rows(), f"base {kind}, target {kind}, alpha double, whole int, base_col int, target_col int")
        return wanted, replicates.segments(chunks, spark.createDataFrame(self.ends(), f"label {kind}, col int, end long"))

    def rows(self) -> list[tuple]:
        """(base, target, alpha, the base's last column, columns of both prefixes, or None of empty ones)."""
        col = {label: {e: k for k, e in enumerate(cut)} for label, cut in self.cuts().items()}
        return [(b, t, x, len(col[b]) - 1, col[b].get(nb), col[t].get(nt)) for b, t, x, nb, nt in self.mixtures()]


def textual_grid(panel: DataFrame, chunks: DataFrame, codecs: tuple[str, ...] = ("gzip", "lzma", "zlib"), tokenizers=TOKENIZERS, orders=ORDERS, sizes=VOCABULARIES) -> DataFrame:
    """One row a (tokenizer, n, v, codec): for each group of directed pairs (bb, bt, tb, tt) their number, mean divergence, agreement and signed
    compression gap, means of finite values alone, and whether the two orderings hold. Codecs see all chunks, ``MAX_CHUNKS`` a stream."""
    directed = pairs.directed(panel).withColumn("grp", F.when(F.col("pair_class") == "broad_broad", "bb").when(F.col("pair_class") == "targeted_targeted", "tt").when(F.col("direction") == "forward", "bt").otherwise("tb"))
    chunks = chunks.join(F.broadcast(panel.select("label")), "label")  # no other corpus is in a pair
    counts = held(frequent.frequent_counts(chunks, max(sizes), tokenizers, orders))
    cells = lexical.cells(lexical.vocabulary(counts, max(sizes)), counts, directed.select("a", "b"), sizes).join(directed.select("a", "b", "grp"), ["a", "b"])
    names = ["bb", "bt", "tb", "tt"]
    words = cells.groupBy("tokenizer", "n", "v").pivot("grp", names).agg(pairs.finite_mean("js").alias("lexical_js"), pairs.finite_mean("rho").alias("rho"))
    values = held(compression.whole_ratios(chunks, codecs, MAX_CHUNKS))
    gaps = compression.gaps(values, directed.select("a", "b", "grp"), [f"{c}_ratio" for c in codecs], signed=True)
    long = gaps.select("grp", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(f"{c}_ratio_gap").alias("gap")) for c in codecs))).alias("x")).select("grp", "x.*")
    sides = long.groupBy("codec").pivot("grp", names).agg(F.count(F.lit(1)).alias("count"), pairs.finite_mean("gap").alias("compression_gap"))
    out = words.crossJoin(F.broadcast(sides))
    return out.withColumn("lexical_js_held", F.coalesce(F.col("bt_lexical_js") > F.col("bb_lexical_js"), F.lit(False))).withColumn("rho_held", F.coalesce(F.col("bb_rho") > F.col("bt_rho"), F.lit(False)))


def cluster_stability(panel: DataFrame, vectors: DataFrame, sweep: tuple[int, ...] = CLUSTER_SWEEP) -> DataFrame:
    """(k, pair_class, pairs, semantic_cluster_js): family means for each number of clusters."""
    p = pairs.unordered(panel)
    js = semantic.occupancy_js(semantic.cluster_counts(vectors, p, sweep, rounds=CLUSTER_ROUNDS), times="n", by=("k",)).join(F.broadcast(p), ["a", "b"])
    return js.groupBy("pair_class", "k").agg(F.count("*").alias("pairs"), F.avg("semantic_cluster_js").alias("semantic_cluster_js")).select("pair_class", "pairs", "semantic_cluster_js", "k")


def battery(spark: SparkSession, recipe: str, out: str, base: str = ".", encoder=None, replicates: int = 200, repeats: int = 50, allow_short: bool = False, only: list[str] | None = None, **given) -> list[str]:
    """All analyses of a recipe in their order, each a folder below ``out``; what is there already isn't done again.

    Returns the steps that were done. ``encoder`` has ``tokens(text)``, the rows of a text's token vectors; ``given`` goes to
    ``build_chunks``; ``only`` names the steps wanted.
    """
    q = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda name: (p := q(f"{out}/{name}/_SUCCESS")).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    read, done = (lambda name: spark.read.parquet(f"{out}/{name}")), []
    if not there("chunks"):
        build_chunks(spark, recipe, out, base, allow_short=allow_short, overwrite=True, **given)
        done.append("chunks")
    chunks = read("chunks")
    panel = readers.recipe(spark, recipe).select("label", "ord", "role")
    if not there("vectors"):
        semantic.embed(chunks, encoder or semantic.HashedGrams()).selectExpr("label", "chunk_index AS vec_id", "embedding").write.mode("overwrite").parquet(f"{out}/vectors")
        done.append("vectors")
    vectors = read("vectors")
    studied = panel.filter("role <> 'candidate'")
    rows = lambda: bootstrap_metrics(studied, chunks, vectors, replicates)
    steps = {
        "orderings": lambda: corpus_matrix(panel, chunks, vectors, out),
        "mixtures": lambda: mixture_panel(panel, chunks, vectors),
        "textual_grid": lambda: textual_grid(studied, chunks),
        "cluster_stability": lambda: cluster_stability(studied, vectors),
        "bootstrap": rows,
        "bootstrap_summary": lambda: bootstrap_summary(read("bootstrap"))[0],
        "bootstrap_orderings": lambda: bootstrap_summary(read("bootstrap"))[1],
        "leave_one_out": lambda: pairs.leave_one_out(read("pairs").filter("direction = 'forward'"), panel, list(METRICS)),
        "splits": lambda: split_metrics(chunks, vectors, repeats),
        "split_summary": lambda: resample.split_summary(read("splits"), list(METRICS)),
    }
    for name, step in steps.items():
        if (only is None or name in only) and not there(name):
            made = step()
            if made is not None:
                made.write.mode("overwrite").parquet(f"{out}/{name}")
            done.append(name)
            release()
    return done


def continuous(panel: DataFrame, vectors: DataFrame, clusters: DataFrame, projections: int = PROJECTIONS) -> DataFrame:
    """Pairs with centroid distances, sliced Wasserstein distances and known cluster divergences."""
    p = pairs.unordered(panel)
    far = semantic.centroid_distances(vectors, p).join(semantic.projected_wasserstein(vectors, p, projections), ["a", "b", "pair_class"])
    return pairs.attach(far, clusters, "semantic_cluster_js")


def near_ceiling_ranking(rows: DataFrame, limit: float = NEAR_CEILING) -> DataFrame:
    """``continuous`` pairs whose cluster divergence is near its ceiling, by sliced Wasserstein distance: (place, a, b, ...), farthest first."""
    near = semantic.near_ceiling(rows, limit)
    place = F.row_number().over(Window.orderBy(F.desc("sliced_wasserstein_l1"), "a", "b"))  # a row a pair of corpora
    return near.withColumn("place", place)


def semantic_sweep(panel: DataFrame, docs: DataFrame, encoders: dict | None = None, sizes: tuple[int, ...] = (256, 512, 768, 1024), k: int = CLUSTERS) -> DataFrame:
    """(encoder, chars, pair_class, pairs, semantic_cluster_js, top1_abs_diff, top5_abs_diff): family means for every encoder and size of
    chunks, of all chunks of ``docs`` (label, doc_id, text)."""
    p, out, names = pairs.unordered(panel), None, ["semantic_cluster_js", "top1_abs_diff", "top5_abs_diff"]
    for size in sizes:
        rows = chunking.chunk(docs.join(F.broadcast(panel.select("label")), "label"), Chunking(size, None, None, None))
        numbered = rows.withColumn("vec_id", F.xxhash64("doc_id", "chunk_in_document"))
        for name, encoder in (encoders or semantic.ENCODERS).items():
            vectors = held(semantic.embed(numbered, encoder).select("label", "vec_id", "embedding"))
            alone = semantic.spectrum(vectors).withColumnsRenamed({"top1_share": "top1", "top5_share": "top5"})
            far = compression.gaps(alone, p, ["top1", "top5"]).join(semantic.occupancy_js(semantic.cluster_counts(vectors, p, (k,), rounds=CLUSTER_ROUNDS), k, times="n"), ["a", "b"])
            part = pairs.family_means(far, names).select(F.lit(name).alias("encoder"), F.lit(size).alias("chars"), "pair_class", "pairs", *names)
            out = part if out is None else out.unionByName(part)
    return out


def figure_data(out: str, spark: SparkSession) -> dict[str, DataFrame]:
    """What figures of a matrix show: multipliers and one symmetric matrix a metric; plotting is left to the caller."""
    rows = spark.read.parquet(f"{out}/pairs")
    labels = sorted(r.a for r in rows.select("a").distinct().collect())
    once = rows.filter("direction = 'forward'")
    return {"multipliers": pairs.multipliers(spark.read.parquet(f"{out}/family"))} | {m: pairs.matrix(once, m, labels) for m in METRICS}


def package(label: str, display: str, source: dict, out: str, target: str, spark: SparkSession) -> dict:
    """A submission of one corpus of a matrix: its entry with standalone values and pairs, files' digests, an archive."""
    alone = spark.read.parquet(f"{out}/standalone").filter(F.col("label") == label).first()
    if alone is None:
        raise ValueError(f"{label} isn't in the matrix")
    near = [r.asDict() for r in pairs.touching(spark.read.parquet(f"{out}/pairs"), [label]).orderBy("a", "b").collect()]
    values = {"n_chunks": alone.n_chunks, "compression_ratio_lzma": alone.lzma_ratio, "semantic_spectrum": {k: alone[k] for k in ("total_variance", "top1_share", "top5_share")}}
    sinks.write_json(near, f"{target}/pairs.json")
    artifact = sinks.copy_with_digest(f"{target}/pairs.json", f"{target}/artifact/pairs.json")
    entry = scorecard.package_entry(label, display, source, values, near, artifact={"url": artifact["path"], "sha256": artifact["sha256"]})
    sinks.write_json(entry, f"{target}/entry.json")
    sinks.package(target, f"{target}.zip")
    return entry


def submission(spark: SparkSession, labels: list[str], panel: DataFrame, out: str, target: str, files: dict[str, list[str]] | None = None, submitter: str = "", notes: str = "", tier: str = "submitted", artifact: dict | None = None, archive: bool = False) -> dict:
    """A bundle of several corpora of a matrix: their entries, artefacts with digests, the pairs that they are in and the panel's families.

    ``panel`` (label, ord, role, and whatever describes a source) names all corpora, ``files`` each label's artefacts. Labels that the
    panel lacks, and a bundle that is there already, are errors before anything is written.
    """
    if not labels:
        raise ValueError("a submission names a corpus at least")
    wanted = spark.createDataFrame([(x,) for x in labels], "label string")
    missing = sorted(r.label for r in scorecard.missing_labels(wanted, panel).collect())
    if missing:
        raise ValueError(f"not in the panel: {', '.join(missing)}")
    if Path(target).exists():
        raise FileExistsError(target)
    of = {r.label: r.asDict() for r in panel.join(wanted, "label").collect()}
    alone = {r.label: r.asDict() for r in spark.read.parquet(f"{out}/standalone").join(wanted, "label").collect()}
    near = [r.asDict() for r in pairs.touching(spark.read.parquet(f"{out}/pairs"), labels).orderBy("a", "b").collect()]
    rows = []
    for label in labels:
        copied = [sinks.copy_with_digest(f, f"{target}/artifacts/{label}/{Path(f).name}") for f in (files or {}).get(label, [])]
        rows.append({"label": label, "panel": of[label], "artifacts": [c | {"path": str(Path(c["path"]).relative_to(target))} for c in copied], "standalone": alone.get(label)})
        if label in alone:
            a = alone[label]
            values = {"n_chunks": a["n_chunks"], "compression_ratio_lzma": a["lzma_ratio"], "semantic_spectrum": {k: a[k] for k in ("total_variance", "top1_share", "top5_share")}}
            about = {"source": str(of[label].get("path") or of[label].get("dataset") or label)}
            entry = scorecard.package_entry(label, str(of[label].get("display") or label), about, values, [p for p in near if label in (p["a"], p["b"])], tier, artifact)
            sinks.write_json(entry, f"{target}/entries/{label}.json")
    sinks.write_json(near, f"{target}/pairs.json")
    sinks.write_json([r.asDict() for r in spark.read.parquet(f"{out}/family").orderBy("pair_class").collect()], f"{target}/family.json")
    whole = {"submitter": submitter, "notes": notes, "requested_tier": tier, "artifact": artifact or {}, "corpora": rows}
    sinks.write_json(whole, f"{target}/submission.json")
    made = spark.createDataFrame([(x, str(of[x].get("role")), len(r["artifacts"])) for x, r in zip(labels, rows, strict=True)], "corpus string, role string, artifacts int")
    text = sinks.report("Submission", [f"submitter: `{submitter or 'NA'}`", f"tier asked for: `{tier}`", f"pairs: `{len(near)}`", *([notes] if notes else [])], {"Corpora": made})
    Path(target, "README.md").write_text(text)
    if archive:
        sinks.package(target, f"{target}.zip")
    return whole
