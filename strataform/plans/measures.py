"""Named queries over resampled and composed corpora, orderings and measures that need no reading of chunks, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataform.catalog import ORACLES
from strataform.config import ALPHAS
from strataform.operators import compression, extract, lexical, ordinals, pairs, replicates, resample, sampling, semantic
from strataform.plans import analyses
from strataform.plans.held import held
from strataform.plans.oracles import ALL_GRAMS1, BOOT, BOTH, CHUNKS, DISTANCES, DRAW, FAMILY, LONG, NORMAL, ORDERED, PANEL, SPACE, UNORDERED, VPANEL, at, boot, halved
from strataform.plans.queries import SEED, _bootstrap, _fixed, _splits, directed_pairs, docs, numbered, panel, query, rounded, studied, vector_panel, vectors

TEXT = ["lexical_js", "rho"]
SMALL = {"tokenizers": ("stable",), "orders": (1,), "sizes": (256,)}


# Means, counts and orderings


@query
def a5_finite_mean(spark, sf):
    """Values of events, of which some are made infinite and some not a number."""
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", x.alias("x"))
    return rounded(rows.groupBy("event_type").agg(pairs.finite_mean("x").alias("mean")), "mean")


@query
def a7_ordering_counts(spark, sf):
    """In how many of the bootstrap's replicates each ordering held."""
    return pairs.held_counts(pairs.checks(_bootstrap(spark, sf, 4), TEXT, ("replicate",)))


@query
def a14_bootstrap_summary(spark, sf):
    """Quantiles over replicates, of both lexical metrics and every family."""
    return rounded(resample.summary(_bootstrap(spark, sf, 4), TEXT), "mean", "median", "q025", "q500", "q975")


@query
def m17_ordering_table(spark, sf):
    """Every metric's ordering as a row, from families of lexical and of vector measures."""
    words = pairs.checks(pairs.directed_family(directed_pairs(spark, sf)), TEXT)
    p = pairs.unordered(studied(vector_panel(spark, sf)))
    near = _fixed(spark, sf).join(p, ["a", "b"])
    return rounded(words.unionByName(pairs.checks(pairs.family_means(near, ["semantic_cluster_js"]), ["semantic_cluster_js"])), "lhs", "rhs")


@query
def p7_separation_table(spark, sf):
    words = pairs.separations(pairs.directed_family(directed_pairs(spark, sf)), TEXT)
    p = pairs.unordered(studied(vector_panel(spark, sf)))
    near = pairs.family_means(_fixed(spark, sf).join(p, ["a", "b"]), ["semantic_cluster_js"])
    return rounded(words.unionByName(pairs.separations(near, ["semantic_cluster_js"])), "multiplier")


@query
def m1_normalize(spark, sf):
    """Shares of quantities within return flags; a flag whose quantities are all 0 is uniform."""
    x = F.sum(F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity").cast("double"))).alias("x")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(x)
    share = lexical.normalized(F.col("x"), Window.partitionBy("l_returnflag"))
    return rounded(rows.withColumn("share", share).drop("x"), "share")


@query
def m11_variance_gaps(spark, sf):
    """Absolute differences of a value that each corpus has alone."""
    alone = semantic.total_variance(vectors(spark, sf))
    return rounded(compression.gaps(alone, pairs.unordered(vector_panel(spark, sf)), ["total_variance"]), "total_variance_abs_diff")


@query
def m15_sliced_wasserstein_exact(spark, sf):
    """All values of every dimension, between the merged breakpoints of both quantile functions."""
    out = semantic.projected_wasserstein(vectors(spark, sf), pairs.unordered(vector_panel(spark, sf)))
    return rounded(out, "sliced_wasserstein_l1", "sliced_wasserstein_l2")


@query
def m16_continuous_means(spark, sf):
    """All four continuous measures' means by family."""
    p = pairs.unordered(studied(vector_panel(spark, sf)))
    far = semantic.centroid_distances(vectors(spark, sf), p).join(semantic.projected_wasserstein(vectors(spark, sf), p), ["a", "b", "pair_class"])
    names = ["centroid_cosine_distance", "centroid_l2_distance", "sliced_wasserstein_l1", "sliced_wasserstein_l2"]
    return rounded(pairs.family_means(far, names), *names)


@query
def x12_near_ceiling(spark, sf):
    """Studied pairs of a cluster divergence of 0.05 or more, by their exact sliced Wasserstein distance."""
    p = studied(vector_panel(spark, sf))
    far = semantic.projected_wasserstein(vectors(spark, sf), pairs.unordered(p))
    rows = rounded(pairs.attach(far, _fixed(spark, sf), "semantic_cluster_js"), "sliced_wasserstein_l1", "sliced_wasserstein_l2", "semantic_cluster_js")
    return analyses.near_ceiling_ranking(rows, 0.05).withColumn("place", F.col("place").cast("long"))


@query
def j9_metric_pivot(spark, sf):
    """Measures in long form, merged to one row a pair."""
    rows = semantic.centroid_distances(vectors(spark, sf), pairs.unordered(vector_panel(spark, sf)))
    names = ["centroid_cosine_distance", "centroid_l2_distance"]
    long = rows.select("a", "b", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))).alias("x")).select("a", "b", "x.*")
    return rounded(pairs.merged(long, names), *names)


@query
def j8_positional_zip(spark, sf):
    """Corpora whose chunks and vectors, joined by place, differ in number."""
    v = vectors(spark, sf)
    return analyses.mismatched(v.filter("label < 8").select("label"), v.filter("label > 1 AND NOT (label = 5 AND vec_id % 2 = 0)").select("label"))


# Documents that hold nothing


def _blanked(spark, sf):
    return docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t")).when(F.col("doc_id") % 11 != 0, F.col("text")))


@query
def c2_prefix_of_filled(spark, sf):
    """Blank and missing texts use up neither ordinals nor the budget."""
    return sampling.prefix(_blanked(spark, sf), 30, 3).select("label", "doc_id", "source_document_index")


@query
def c3_reservoir_of_scanned(spark, sf):
    """A sample of 10 of each corpus's first 25 documents with text behind the first 3."""
    some = sampling.scanned(_blanked(spark, sf), 25, 3)
    return sampling.reservoir(some, 10, SEED).select("label", "doc_id", "source_document_index", "document_sample_rank")


@query
def e12_skip_filled(spark, sf):
    return extract.skip_first(_blanked(spark, sf), 5).select("label", "doc_id", F.col("source_document_index").cast("long").alias("source_document_index"))


@query
def x1_build_chunks(spark, sf):
    """Chunks of all corpora, a different recipe entry for broad and for other ones."""
    rows = _blanked(spark, sf).join(panel(spark, sf).select("label", "role"), "label")
    one = analyses.Settings.of({"max_documents": 20, "skip_nonempty_documents": 2, "max_chunks": 30, "chunk_chars": 512})
    two = analyses.Settings.of({"sampling_mode": "reservoir", "sample_scan_documents": 25, "sample_reservoir_documents": 8, "max_chunks": 12, "max_chunks_per_source_document": 3})
    broad = F.col("role") == "broad"
    out = analyses.corpus_chunks(rows.filter(broad), one).unionByName(analyses.corpus_chunks(rows.filter(~broad), two))
    return out.select("label", "chunk_index", "doc_id", "source_document_index", "document_sample_rank", F.col("chunk_in_document").cast("long").alias("chunk_in_document"), "chunk_sha256")


# Resampled and mixed corpora


@query
def m10_bootstrap_clusters(spark, sf):
    """Cluster divergence of resampled vectors under partitions that were fixed once (by nearest corpus mean), three replicates."""
    return _fixed_partitions(spark, sf, 3)


def _fixed_partitions(spark, sf, number):
    """Occupancies of all replicates are counted once a corpus, then met by pairs: a row a corpus, replicate and cluster."""
    v, p = vectors(spark, sf), pairs.unordered(studied(vector_panel(spark, sf)))
    own = ordinals.ahead(v.select("label", "vec_id").join(F.broadcast(studied(vector_panel(spark, sf)).select("label")), "label"), ["label"], ["vec_id"]).withColumnRenamed("ahead", "chunk_index")
    slots = sampling.bootstrap_slots(own.groupBy("label").agg(F.count("*").alias("n")), spark.range(number).withColumnRenamed("id", "replicate"), SEED)
    near = semantic.nearest_centroid(v).join(own, ["label", "vec_id"]).select("label", "chunk_index", "cluster")
    met = replicates.column_counts(near, replicates.packed(slots), "cluster").withColumnRenamed("col", "replicate")
    sides = F.broadcast(p.select("a", "b", F.explode(F.array("a", "b")).alias("label")))
    js = semantic.occupancy_js(met.join(sides, "label"), times="n", by=("replicate",)).join(F.broadcast(p), ["a", "b"])
    out = js.groupBy(F.col("replicate").cast("long").alias("replicate"), "pair_class").agg(F.avg("semantic_cluster_js").alias("semantic_cluster_js"))
    return rounded(out, "semantic_cluster_js")


@query
def x10_mixture_rates(spark, sf):
    """Shares of chunks of every mixture that refuse or hold a word of a kind."""
    targeted = panel(spark, sf).filter("role = 'targeted'")
    rows = held(numbered(spark, sf).join(targeted.select("label"), "label"))
    wanted, cols = analyses.Mixtures.of(targeted, rows, ALPHAS).frames(rows)
    flags = rows.select("label", "chunk_index", F.col("text").rlike(extract.REFUSAL).cast("long").alias("refuses"), F.col("text").rlike(r"(?i)\bth").cast("long").alias("flag"))
    out = analyses.mixed_sums(wanted, flags, cols, ["refuses", "flag"])
    return rounded(out.select("base", "target", "alpha", F.col("n").alias("chunks"), (F.col("refuses") / F.col("n")).alias("refusal_rate"), (F.col("flag") / F.col("n")).alias("flag_rate")), "refusal_rate", "flag_rate")


def _text_corpora(spark, sf):
    """Studied corpora with numbered chunks and vectors of the stand-in encoder, which every step over vectors reads."""
    p = studied(panel(spark, sf))
    rows = numbered(spark, sf).join(p.select("label"), "label")
    return p, rows, held(semantic.embed(rows).selectExpr("label", "chunk_index AS vec_id", "embedding"))


@query
def x5_bootstrap_metrics(spark, sf):
    """Family means of all six metrics for two replicates."""
    p, rows, vecs = _text_corpora(spark, sf)
    out = analyses.bootstrap_metrics(p, rows, vecs, 2, SEED, **SMALL)
    return rounded(out.groupBy("replicate", "pair_class").agg(*(F.avg(m).alias(m) for m in analyses.METRICS)), *analyses.METRICS)


@query
def x7_split_metrics(spark, sf):
    """All six metrics between halves of each corpus."""
    p, rows, vecs = _text_corpora(spark, sf)
    return rounded(analyses.split_metrics(rows, vecs, 1, SEED, **SMALL), *analyses.METRICS)


@query
def x10_mixture_panel(spark, sf):
    """All values of mixtures of the targeted corpora, at one share."""
    p, rows, vecs = _text_corpora(spark, sf)
    out = analyses.mixture_panel(p, rows, vecs, (0.0, 0.5), **SMALL)
    return rounded(out, *(c for c in out.columns if c not in ("base", "target", "alpha")))


@query
def x4_textual_grid(spark, sf):
    """Lexical settings by codecs, with signed compression gaps and both orderings."""
    out = analyses.textual_grid(studied(panel(spark, sf)), numbered(spark, sf), tokenizers=("stable",), orders=(1, 2), sizes=(256,))
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


# Production counts: what the queries above do with few, to keep their SQL short

REPLICATES, REPEATS = 200, 50


@query
def c8_bootstrap_production(spark, sf):
    return rounded(_bootstrap(spark, sf, REPLICATES), *TEXT)


@query
def a7_ordering_production(spark, sf):
    return pairs.held_counts(pairs.checks(_bootstrap(spark, sf, REPLICATES), TEXT, ("replicate",)))


@query
def a14_bootstrap_production(spark, sf):
    return rounded(resample.summary(_bootstrap(spark, sf, REPLICATES), TEXT), "mean", "median", "q025", "q500", "q975")


@query
def c10_split_production(spark, sf):
    """Every repeat's distance between the halves of each corpus."""
    return rounded(_splits(spark, sf, REPEATS), *TEXT)


@query
def a15_split_production(spark, sf):
    """Quantiles over corpora of their means over repeats."""
    return rounded(resample.split_summary(_splits(spark, sf, REPEATS), TEXT), "mean", "median", "q025", "q500", "q975")


@query
def m10_bootstrap_clusters_production(spark, sf):
    return _fixed_partitions(spark, sf, REPLICATES)


@query
def x5_bootstrap_production(spark, sf):
    """Quantiles over 200 replicates of all six metrics, over all 18 settings."""
    p, rows, vecs = _text_corpora(spark, sf)
    out = analyses.bootstrap_metrics(p, rows, vecs, REPLICATES, SEED)
    return rounded(analyses.bootstrap_summary(out)[0], "mean", "median", "q025", "q500", "q975")


@query
def x7_split_production(spark, sf):
    p, rows, vecs = _text_corpora(spark, sf)
    return rounded(analyses.split_metrics(rows, vecs, REPEATS, SEED), *analyses.METRICS)


@query
def x10_mixture_production(spark, sf):
    """All six shares, over all 18 settings."""
    p, rows, vecs = _text_corpora(spark, sf)
    out = analyses.mixture_panel(p, rows, vecs)
    return rounded(out, *(c for c in out.columns if c not in ("base", "target", "alpha")))


@query
def x4_textual_production(spark, sf):
    """All 54 settings."""
    out = analyses.textual_grid(studied(panel(spark, sf)), numbered(spark, sf))
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


BLANKED = "blanked AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 11 <> 0 THEN text END AS text FROM documents)"
FILLED = f"{BLANKED}, filled AS (SELECT source AS label, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM blanked WHERE regexp_replace(coalesce(text, ''), {SPACE}, '', 'g') <> '')"
SCANNED = "drawn AS (SELECT label, doc_id, text, i - {skip} AS source_document_index, row_number() OVER (PARTITION BY label ORDER BY md5('20260505|' || label || '|' || doc_id), doc_id) - 1 AS document_sample_rank FROM filled WHERE i >= {skip} AND i < {end})"


def pieces(source: str, size: int, most: int) -> str:
    """Windows of the rows of ``source``, at most ``most`` a document."""
    least = max(64, size // 4)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, doc_id ORDER BY s) - 1 AS chunk_in_document FROM (
  SELECT label, doc_id, source_document_index, document_sample_rank, o, s, regexp_replace(substr(t, s + 1, {size}), {SPACE}, '', 'g') AS piece FROM (
   SELECT *, unnest(range(0, length(t), {size})) AS s FROM (SELECT *, regexp_replace(text, {SPACE}, '', 'g') AS t FROM {source}))) WHERE length(piece) >= {least}) WHERE chunk_in_document < {most}"""


EXACT = f"""{NORMAL}, {VPANEL}, {UNORDERED}, z AS (SELECT label, dim, value, row_number() OVER (PARTITION BY label, dim ORDER BY value) AS i, count(*) OVER (PARTITION BY label, dim) AS n FROM normal),
 o AS (SELECT u.a, u.b, u.pair_class, x.dim, abs(x.value - y.value) AS d, least(x.i::DOUBLE / x.n, y.i::DOUBLE / y.n) - greatest((x.i - 1)::DOUBLE / x.n, (y.i - 1)::DOUBLE / y.n) AS w
  FROM unordered u JOIN z x ON x.label = u.a JOIN z y ON y.label = u.b AND y.dim = x.dim WHERE x.i * y.n > (y.i - 1) * x.n AND y.i * x.n > (x.i - 1) * y.n),
 one AS (SELECT a, b, pair_class, dim, sum(d * w) AS l1, sum(d * d * w) AS l2 FROM o GROUP BY ALL),
 sliced AS (SELECT a, b, pair_class, avg(l1) AS sliced_wasserstein_l1, sqrt(avg(l2)) AS sliced_wasserstein_l2 FROM one GROUP BY ALL)"""
CLUSTERED = f"""near0 AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings),
 cent0 AS (SELECT label AS cluster, dim, avg(value) AS value FROM near0 GROUP BY ALL),
 d0 AS (SELECT l.label, l.vec_id, c.cluster, round(sum((l.value - c.value) * (l.value - c.value)), 9) AS d FROM near0 l JOIN cent0 c USING (dim) GROUP BY ALL),
 nearest AS (SELECT label, vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY d, cluster) AS k FROM d0) WHERE k = 1),
 vp AS (SELECT label, CASE WHEN label < 4 THEN 'broad' WHEN label < 9 THEN 'targeted' END AS role FROM (SELECT DISTINCT label FROM embeddings) WHERE label < 9),
 vu AS (SELECT x.label AS a, y.label AS b, least(x.role, y.role) || '_' || greatest(x.role, y.role) AS pair_class FROM vp x JOIN vp y ON x.label < y.label),
 vo AS (SELECT label, cluster, count(*) AS n FROM nearest GROUP BY ALL),
 vxy AS (SELECT u.*, k.k, coalesce(x.n, 0) + 1e-12 AS x, coalesce(y.n, 0) + 1e-12 AS y FROM vu u, (SELECT unnest(range(0, 10)) AS k) k LEFT JOIN vo x ON x.label = u.a AND x.cluster = k.k LEFT JOIN vo y ON y.label = u.b AND y.cluster = k.k),
 vpq AS (SELECT *, x / sum(x) OVER (PARTITION BY a, b) AS p, y / sum(y) OVER (PARTITION BY a, b) AS q FROM vxy),
 vjs AS (SELECT a, b, pair_class, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) AS js FROM vpq GROUP BY ALL),
 vfam AS (SELECT pair_class, avg(js) AS js FROM vjs GROUP BY 1)"""

ORACLES |= {
    "a5_finite_mean": "SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY 1",
    "a7_ordering_counts": f"""{BOOT}, w AS (SELECT replicate, {at('broad_broad', 'lexical_js')} AS jb, {at('broad_targeted', 'lexical_js')} AS jt, {at('broad_broad', 'rho')} AS rb, {at('broad_targeted', 'rho')} AS rt FROM rows GROUP BY 1)
 SELECT 'lexical_js' AS metric, count(*) FILTER (WHERE jt > jb) AS held, count(*) AS total FROM w UNION ALL SELECT 'rho', count(*) FILTER (WHERE rb > rt), count(*) FROM w""",
    "a14_bootstrap_summary": f"""{BOOT}, l AS (SELECT 'lexical_js' AS metric, pair_class, lexical_js AS v FROM rows UNION ALL SELECT 'rho', pair_class, rho FROM rows)
 SELECT metric, pair_class, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.5), 6) AS q500, round(quantile_cont(v, 0.975), 6) AS q975 FROM l GROUP BY ALL""",
    "m17_ordering_table": f"""{BOTH}, {FAMILY}, {CLUSTERED}, t AS (SELECT 'lexical_js' AS metric, {at('broad_targeted', 'lexical_js')} AS lhs, {at('broad_broad', 'lexical_js')} AS rhs FROM family
 UNION ALL SELECT 'rho', {at('broad_broad', 'rho')}, {at('broad_targeted', 'rho')} FROM family UNION ALL SELECT 'semantic_cluster_js', {at('broad_targeted', 'js')}, {at('broad_broad', 'js')} FROM vfam)
 SELECT metric, round(lhs, 6) AS lhs, round(rhs, 6) AS rhs, lhs > rhs AS held FROM t""",
    "p7_separation_table": f"""{BOTH}, {FAMILY}, {CLUSTERED} SELECT 'lexical_js' AS metric, round({at('broad_targeted', 'lexical_js')} / {at('broad_broad', 'lexical_js')}, 6) AS multiplier FROM family
 UNION ALL SELECT 'rho', round((1 - {at('broad_targeted', 'rho')}) / (1 - {at('broad_broad', 'rho')}), 6) FROM family UNION ALL SELECT 'semantic_cluster_js', round({at('broad_targeted', 'js')} / {at('broad_broad', 'js')}, 6) FROM vfam""",
    "m1_normalize": """WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS DOUBLE) END) AS x FROM lineitem GROUP BY ALL)
 SELECT l_returnflag, l_linestatus, l_linenumber, round(CASE WHEN sum(x) OVER w > 0 THEN x / sum(x) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS share FROM r WINDOW w AS (PARTITION BY l_returnflag)""",
    "m11_variance_gaps": f"""WITH {LONG}, {VPANEL}, {UNORDERED}, t AS (SELECT label, sum(v) AS tv FROM (SELECT label, dim, var_samp(value) AS v FROM long GROUP BY ALL) GROUP BY 1)
 SELECT a, b, pair_class, round(abs(x.tv - y.tv), 6) AS total_variance_abs_diff FROM unordered JOIN t x ON x.label = a JOIN t y ON y.label = b""",
    "m15_sliced_wasserstein_exact": f"WITH {EXACT} SELECT a, b, pair_class, round(sliced_wasserstein_l1, 6) AS sliced_wasserstein_l1, round(sliced_wasserstein_l2, 6) AS sliced_wasserstein_l2 FROM sliced",
    "m16_continuous_means": f"""WITH {EXACT}, cent AS (SELECT label, dim, avg(value) AS value FROM normal GROUP BY ALL),
 dist AS (SELECT a, b, pair_class, 1 - sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))) AS c, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS l FROM unordered JOIN cent x ON x.label = a JOIN cent y ON y.label = b AND y.dim = x.dim GROUP BY ALL)
 SELECT pair_class, count(*) AS pairs, round(avg(c), 6) AS centroid_cosine_distance, round(avg(l), 6) AS centroid_l2_distance, round(avg(sliced_wasserstein_l1), 6) AS sliced_wasserstein_l1, round(avg(sliced_wasserstein_l2), 6) AS sliced_wasserstein_l2
 FROM dist JOIN sliced USING (a, b, pair_class) WHERE pair_class <> 'candidate_pair' GROUP BY 1""",
    "x12_near_ceiling": f"""WITH {EXACT}, {CLUSTERED}, r AS (SELECT a, b, s.pair_class, round(sliced_wasserstein_l1, 6) AS sliced_wasserstein_l1, round(sliced_wasserstein_l2, 6) AS sliced_wasserstein_l2, round(js, 6) AS semantic_cluster_js FROM sliced s JOIN vjs USING (a, b))
 SELECT *, row_number() OVER (ORDER BY sliced_wasserstein_l1 DESC, a, b) AS place FROM r WHERE semantic_cluster_js >= 0.05""",
    "j9_metric_pivot": f"WITH {DISTANCES} SELECT a, b, round(centroid_cosine_distance, 6) AS centroid_cosine_distance, round(centroid_l2_distance, 6) AS centroid_l2_distance FROM dist",
    "j8_positional_zip": """WITH c AS (SELECT label, count(*) AS chunks FROM embeddings WHERE label < 8 GROUP BY 1), v AS (SELECT label, count(*) AS vectors FROM embeddings WHERE label > 1 AND NOT (label = 5 AND vec_id % 2 = 0) GROUP BY 1)
 SELECT label, chunks, vectors FROM c FULL JOIN v USING (label) WHERE chunks IS DISTINCT FROM vectors""",
    "c2_prefix_of_filled": f"WITH {FILLED} SELECT label, doc_id, i AS source_document_index FROM filled WHERE i >= 3 AND i < 30",
    "c3_reservoir_of_scanned": f"WITH {FILLED}, {SCANNED.format(skip=3, end=28)} SELECT label, doc_id, source_document_index, document_sample_rank FROM drawn WHERE document_sample_rank < 10",
    "e12_skip_filled": f"WITH {FILLED} SELECT label, doc_id, i AS source_document_index FROM filled WHERE i >= 5",
    "x1_build_chunks": f"""WITH {PANEL}, {FILLED}, {SCANNED.format(skip=0, end=25)},
 one AS (SELECT label, doc_id, text, i AS source_document_index, CAST(NULL AS BIGINT) AS document_sample_rank, i AS o FROM filled JOIN panel USING (label) WHERE role = 'broad' AND i >= 2 AND i < 20),
 two AS (SELECT label, doc_id, text, source_document_index, document_sample_rank, document_sample_rank AS o FROM drawn JOIN panel USING (label) WHERE role <> 'broad' AND document_sample_rank < 8),
 pieces AS (SELECT 30 AS most, * FROM ({pieces('one', 512, 2)}) UNION ALL SELECT 12, * FROM ({pieces('two', 768, 3)}))
 SELECT label, chunk_index, doc_id, source_document_index, document_sample_rank, chunk_in_document, sha256(piece) AS chunk_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, chunk_in_document) - 1 AS chunk_index FROM pieces) WHERE chunk_index < most""",
    "m10_bootstrap_clusters": f"""WITH {CLUSTERED}, idx AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 draws AS (SELECT replicate, label, {DRAW("'20260505|' || replicate || '|' || label || '|' || chunk_index")} % n AS chunk_index FROM idx, (SELECT unnest(range(0, 3)) AS replicate)),
 occ AS (SELECT replicate, label, cluster, count(*) AS n FROM draws JOIN idx USING (label, chunk_index) JOIN nearest USING (label, vec_id) GROUP BY ALL),
 top AS (SELECT u.a, u.b, u.pair_class, o.replicate, max(o.cluster) AS top FROM vu u JOIN occ o ON o.label = u.a OR o.label = u.b GROUP BY ALL),
 g AS (SELECT *, unnest(range(0, top + 1)) AS k FROM top),
 xy AS (SELECT g.*, coalesce(x.n, 0) + 1e-12 AS x, coalesce(y.n, 0) + 1e-12 AS y FROM g LEFT JOIN occ x ON x.label = g.a AND x.cluster = k AND x.replicate = g.replicate LEFT JOIN occ y ON y.label = g.b AND y.cluster = k AND y.replicate = g.replicate),
 pq AS (SELECT *, x / sum(x) OVER (PARTITION BY replicate, a, b) AS p, y / sum(y) OVER (PARTITION BY replicate, a, b) AS q FROM xy),
 js AS (SELECT replicate, pair_class, a, b, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) AS js FROM pq GROUP BY ALL)
 SELECT replicate, pair_class, round(avg(js), 6) AS semantic_cluster_js FROM js GROUP BY ALL""",
    "x10_mixture_rates": rf"""WITH {PANEL}, {CHUNKS}, {ORDERED}, i AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, chunk_in_document) - 1 AS chunk_index FROM chunks), alphas AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) t(alpha)),
 sizes AS (SELECT label, count(*) AS n FROM i GROUP BY 1),
 plan AS (SELECT o.a AS base, o.b AS target, alpha, n, CAST(round_even(n * alpha, 0) AS BIGINT) AS nt FROM ordered o JOIN sizes ON sizes.label = o.a JOIN alphas ON true WHERE pair_class = 'targeted_targeted'),
 f AS (SELECT label, chunk_index, CASE WHEN regexp_matches(text, '(?i)\b(?:sorry|cannot|can''t|unable|not able|cannot help|can''t help)\b') THEN 1.0 ELSE 0 END AS r, CASE WHEN regexp_matches(text, '(?i)\bth') THEN 1.0 ELSE 0 END AS m FROM i),
 met AS (SELECT base, target, alpha, r, m FROM plan JOIN f ON f.label = base AND f.chunk_index < n - nt UNION ALL SELECT base, target, alpha, r, m FROM plan JOIN f ON f.label = target AND f.chunk_index < nt)
 SELECT base, target, alpha, count(*) AS chunks, round(avg(r), 6) AS refusal_rate, round(avg(m), 6) AS flag_rate FROM met GROUP BY ALL""",
    "x10_mixture_semantic": f"""WITH {CLUSTERED}, idx AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 known AS (SELECT label, chunk_index, n, cluster FROM idx JOIN nearest USING (label, vec_id)), alphas AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS if a)}) t(alpha)),
 plan AS (SELECT x.label AS base, y.label AS target, alpha, n, CAST(round_even(n * alpha, 0) AS BIGINT) AS nt FROM vp x JOIN vp y ON x.label <> y.label JOIN (SELECT DISTINCT label, n FROM idx) s ON s.label = x.label JOIN alphas ON true WHERE x.role = 'targeted' AND y.role = 'targeted'),
 own AS (SELECT base, target, alpha, cluster, count(*) AS c FROM plan JOIN known ON known.label = base GROUP BY ALL),
 mix AS (SELECT base, target, alpha, cluster, count(*) AS c FROM (SELECT base, target, alpha, cluster FROM plan JOIN known k ON k.label = base AND chunk_index < plan.n - nt UNION ALL SELECT base, target, alpha, cluster FROM plan JOIN known k ON k.label = target AND chunk_index < nt) GROUP BY ALL),
 xy AS (SELECT p.base, p.target, p.alpha, g.k, coalesce(o.c, 0) + 1e-12 AS x, coalesce(m.c, 0) + 1e-12 AS y FROM plan p, (SELECT unnest(range(0, 10)) AS k) g
  LEFT JOIN own o ON o.base = p.base AND o.target = p.target AND o.alpha = p.alpha AND o.cluster = g.k LEFT JOIN mix m ON m.base = p.base AND m.target = p.target AND m.alpha = p.alpha AND m.cluster = g.k),
 pq AS (SELECT *, x / sum(x) OVER (PARTITION BY base, target, alpha) AS p, y / sum(y) OVER (PARTITION BY base, target, alpha) AS q FROM xy)
 SELECT CAST(base AS VARCHAR) AS a, base || '/' || target || '/' || alpha AS b, round(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 6) AS semantic_cluster_js FROM pq GROUP BY base, target, alpha""",
}

_CLUSTERS = ORACLES["m10_bootstrap_clusters"]
_QUANTILES = "round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.5), 6) AS q500, round(quantile_cont(v, 0.975), 6) AS q975"
_MANY, _HALVED = boot(REPLICATES, ALL_GRAMS1), halved(REPEATS, ALL_GRAMS1)
ORACLES |= {
    "c8_bootstrap_production": f"{_MANY} SELECT replicate, pair_class, round(lexical_js, 6) AS lexical_js, round(rho, 6) AS rho FROM rows",
    "a7_ordering_production": ORACLES["a7_ordering_counts"].replace(BOOT, _MANY),
    "a14_bootstrap_production": ORACLES["a14_bootstrap_summary"].replace(BOOT, _MANY),
    "c10_split_production": f"{_HALVED} SELECT string_split(a, '/')[1] AS label, repeat, round(js, 6) AS lexical_js, round(rho, 6) AS rho FROM cells",
    "a15_split_production": f"""{_HALVED}, m AS (SELECT string_split(a, '/')[1] AS label, avg(js) AS js, avg(rho) AS rho FROM cells GROUP BY 1),
 l AS (SELECT 'lexical_js' AS metric, js AS v FROM m UNION ALL SELECT 'rho', rho FROM m) SELECT metric, {_QUANTILES} FROM l GROUP BY 1""",
    "m10_bootstrap_clusters_production": _CLUSTERS.replace("range(0, 3)", f"range(0, {REPLICATES})"),
}
