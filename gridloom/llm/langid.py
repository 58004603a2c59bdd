"""Language identification by Bayesian fusion of independent evidence.

* text: byte trigram likelihoods per language, over the whole text, with a
  uniform byte model beside them for what is no language at all;
* declared language (a column, or the lang attribute of markup): a smoothed
  confusion table, counted over all rows, says how far declarations hold;
* address suffix: the same for the last label of the host;
* host: priors smoothed hierarchically, overall to suffix to host, from
  grouped counts of all rows.

The trigram tables are fitted on a bounded sample of declared rows (about
``sample_rows`` per language); all counts cover all rows. Every declared
language is learned, however rare: its table leans on what all languages have
in common, the more so the fewer rows declare it. A declaration is the primary
subtag of a language tag (two or three letters: ``en`` of ``en-GB``); anything
else counts as undeclared. That bounds the number of languages; each takes half
a megabyte on the driver, and tasks hold ``BLOCK`` of them at a time. Markup is
searched as a whole, and texts of any length are scored in pieces.

Null or empty text has no text evidence: its language comes from the rest and
the row is rejected. Null declarations, hosts and addresses count as unknown.
Repeated rows each get their own result. An empty table gives no rows. Extra
columns pass through where the rows do; an input column named like a result
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stage, text_chunks

BITS = 16
BLOCK = 64
PIECE = 1 << 20
RESULT = ("language", "posterior", "accepted")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_LOWER[[9, 10, 11, 12, 13]] = 32


def trigram_codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed byte trigrams of all texts, each with a space on both sides, and the text of each: in order, in pieces of bounded size."""
    pieces, owners, size = [], [], 0
    for i, t in enumerate(texts):
        whole = b" " + t + b" "
        for at in range(0, len(whole) - 2, PIECE):
            # the trigrams that begin in this piece
            pieces.append(whole[at : at + PIECE + 2])
            owners.append(i)
            size += len(pieces[-1])
            if size >= PIECE:
                yield _codes(pieces, owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield _codes(pieces, owners)


def _codes(pieces: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.uint32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    own = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    own[ends - 1] = own[ends - 2] = False
    return codes[own[:-2]], np.repeat(np.asarray(owners), sizes - 2)


def declared_languages(rows: DataFrame) -> list[tuple[str, int]]:
    """All declared languages and their rows, the commonest first."""
    counts = rows.filter("declared is not null").groupBy("declared").count()
    return [(r[0], r[1]) for r in counts.orderBy(F.desc("count"), "declared").collect()]


def fit(rows: DataFrame, languages: list[tuple[str, int]], sample_rows: int = 1500, common: float = 2000.0) -> np.ndarray:
    """log P(trigram | language), a row per language and a last one for no language."""
    table = np.zeros((len(languages) + 1, 1 << BITS), np.float32)
    names = {n: k for k, (n, _) in enumerate(languages)}
    share = F.element_at(F.create_map(*[F.lit(x) for n, c in languages for x in (n, min(1.0, sample_rows / c))]), F.col("declared"))
    chosen = rows.filter("declared is not null").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            which = np.fromiter(map(names.__getitem__, batch["declared"].to_pylist()), np.int64, len(texts))
            for codes, owner in trigram_codes(texts):
                key, n = np.unique(which[owner] << BITS | codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key >> BITS).astype(np.int32)), pa.array((key & (1 << BITS) - 1).astype(np.int32)), pa.array(n)], names=["k", "code", "n"])

    # at most languages x 65,536 rows
    sums = chosen.mapInArrow(count, "k int, code int, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
    table[sums["k"].to_numpy(), sums["code"].to_numpy()] = sums["n"].to_numpy()
    every = table.sum(0) + 0.5
    table += (0.5 + common * every / every.sum()).astype(np.float32)
    table[-1] = 1.0
    return np.log(table / table.sum(1, keepdims=True))


def add_likelihoods(rows: DataFrame, model: np.ndarray, weight: float = 1 / 3) -> DataFrame:
    """``rows`` with loglik (an array with a value per language and one for none). Trigrams overlap, hence the weight."""
    blocks = [model[at : at + BLOCK] for at in range(0, len(model), BLOCK)]
    for k, block in enumerate(blocks):
        rows = _add_block(rows, np.ascontiguousarray(block.T) * np.float32(weight), f"_loglik{k}")
    parts = [f"_loglik{k}" for k in range(len(blocks))]
    return rows.withColumn("loglik", F.concat(*parts)).drop(*parts)


def _add_block(rows: DataFrame, flat: np.ndarray, name: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value
        for batch, texts in text_chunks(batches, "text", PIECE):
            sums = np.zeros((len(texts), flat.shape[1]))
            for codes, owner in trigram_codes(texts):
                for at in range(0, len(codes), 1 << 15):
                    own = owner[at : at + (1 << 15)]
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    sums[own[starts]] += np.add.reduceat(flat[codes[at : at + (1 << 15)]], starts, axis=0, dtype=np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * flat.shape[1]), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return rows.mapInArrow(score, schema)


def plain_text(markup: str) -> Column:
    """The text of a column of markup: without scripts, styles and tags."""
    scripts = F.regexp_replace(F.col(markup).cast("string"), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(scripts, r"<[^>]*>", " ")


def evidence(df: DataFrame, text: str = "text", declared: str | None = None, host: str | None = None, markup: str | None = None, address: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows (in ``row``) with text, declared, host and suffix: from columns, or from markup and addresses."""
    none = F.lit(None).cast("string")
    lang = F.col(declared).cast("string") if declared else none
    if markup:
        lang = F.coalesce(lang, F.nullif(F.regexp_extract(F.col(markup).cast("string"), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1), F.lit("")))
    lang = F.nullif(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:$|[-_])", 1), F.lit(""))
    name = F.col(host).cast("string") if host else none
    if address:
        name = F.coalesce(name, F.nullif(F.lower(F.regexp_extract(F.col(address), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")))
    suffix = F.nullif(F.regexp_extract(name, r"\.([A-Za-z0-9-]+)$", 1), F.lit(""))
    return df.select(F.struct(*(keep or df.columns)).alias("row"), F.col(text).cast("string").alias("text"), lang.alias("declared"), F.coalesce(name, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix"))


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def tables(scored: DataFrame, n: int, smooth: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """log P(declared | language), log P(suffix | language) and hierarchical host priors, from counts of all rows."""
    # what the text alone says, where it says it clearly enough to count
    seen = scored.select("declared", "host", "suffix", _best("loglik").alias("k")).filter(F.col("k") < n)
    langs = [F.count_if(F.col("k") == i) for i in range(n)]
    counts = stage(seen.groupBy("declared", "host", "suffix").agg(F.array(*langs).alias("c")), "langid-counts")
    add = lambda d, *by: d.groupBy(*by).agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("c"))
    overall = [max(1, r or 0) for r in counts.agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)]).first()]
    total = sum(overall)
    likely = lambda: F.array(*[F.log((F.col("c")[i] + smooth * F.col("share")) / (overall[i] + smooth)) for i in range(n)])
    size = lambda: F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    by_declared = add(counts, "declared").withColumn("share", size() / total).select(F.coalesce("declared", F.lit("")).alias("d_key"), likely().alias("d_log"))
    suffixes = add(counts, "suffix").withColumn("share", size() / total).select(F.col("suffix").alias("s_key"), likely().alias("s_log"), F.array(*[(F.col("c")[i] + smooth * overall[i] / total) / (size() + smooth) for i in range(n)]).alias("s_prior"))
    suffixes = stage(suffixes, "langid-suffixes")
    hosts = add(counts, "host", "suffix").join(suffixes, F.col("suffix") == F.col("s_key")).select(F.col("host").alias("h_key"), F.array(*[F.log((F.col("c")[i] + smooth * F.col("s_prior")[i]) / (size() + smooth)) for i in range(n)]).alias("h_log"))
    return stage(by_declared, "langid-declared"), suffixes.select("s_key", "s_log"), stage(hosts, "langid-hosts")


def fuse(scored: DataFrame, names: list[str], evidence_tables: tuple[DataFrame, DataFrame, DataFrame], reject_below: float = 0.5) -> DataFrame:
    """``scored`` with language, posterior and accepted."""
    n, (by_declared, suffixes, hosts) = len(names), evidence_tables
    # staged tables: Spark knows their sizes, broadcasts small ones and shuffles the rest
    df = scored.withColumn("d_key", F.coalesce("declared", F.lit(""))).join(by_declared, "d_key", "left").join(suffixes, F.col("suffix") == F.col("s_key"), "left").join(hosts, F.col("host") == F.col("h_key"), "left")
    zero = F.lit(0.0)
    known = [F.coalesce(F.col("h_log")[i], F.lit(-float(np.log(n)))) + F.coalesce(F.col("d_log")[i], zero) + F.when(F.col("suffix") == "", zero).otherwise(F.coalesce(F.col("s_log")[i], zero)) + F.col("loglik")[i] for i in range(n)]
    # no language: a thousandth a priori, and as likely to carry any declaration
    none = F.lit(float(np.log(1e-3))) + F.when(F.col("suffix") == "", zero).otherwise(F.lit(-float(np.log(n)))) + F.lit(-float(np.log(n))) + F.col("loglik")[n]
    df = df.withColumn("_all", F.array(*known, none)).withColumn("_k", _best("_all"))
    total = F.aggregate("_all", zero, lambda a, x: a + F.exp(x - F.array_max("_all")))
    language = F.when(F.col("_k") < n, F.get(F.array(*map(F.lit, names)) if names else F.array(F.lit("")), F.col("_k")))
    df = df.withColumn("language", language).withColumn("posterior", 1 / total)
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0 if "text" in scored.columns else F.col("has_text")
    df = df.withColumn("accepted", text & F.col("language").isNotNull() & (F.col("posterior") >= reject_below))
    return df.drop("_all", "_k", "d_key", "d_log", "s_key", "s_log", "h_key", "h_log")


def identify(df: DataFrame, text: str = "text", keep: list[str] | None = None, sample_rows: int = 1500, **sources) -> DataFrame:
    """``df`` with language (null for none), posterior and accepted; ``sources`` name the other evidence (see ``evidence``).

    Scores are staged without texts, for the counts. With ``keep``, the result
    has those columns only and comes from what is staged; else the rows are
    scored once more as they pass, and texts are never shuffled.
    """
    rows = evidence(df, text, keep=keep, **sources)
    languages = declared_languages(rows)
    names = [name for name, _ in languages]
    if not names:
        # nothing to learn from: no language is known, and no row accepted
        own = [c for c in (keep or df.columns) if c not in RESULT]
        return rows.select(*[F.col("row")[c].alias(c) for c in own], *(["declared", "host"] if keep is not None else []), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    model = fit(rows, languages, sample_rows)
    has_text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    narrow = stage(add_likelihoods(rows if keep is not None else rows.drop("row"), model).withColumn("has_text", has_text).drop("text"), "langid-scores")
    learned = tables(narrow, len(names))
    scored = narrow if keep is not None else add_likelihoods(rows, model)
    own = [c for c in (keep or df.columns) if c not in RESULT]
    return fuse(scored, names, learned).select(*[F.col("row")[c].alias(c) for c in own], *(["declared", "host"] if keep is not None else []), *RESULT)
