"""Personal data in whole texts, with DataFrame functions only.

Base spans are what fixed patterns find (email, ip, card, phone), leftmost and
non-overlapping per kind. The method then bootstraps from them:

* every base span and every other identifier-like token (one with a digit or
  an @) is an instance; the two whole words before the token in which it begins
  are its lexical pattern, if no instance of the same sort comes between;
* all occurrences of each pattern that precedes ``support`` different values or
  more are counted in all texts, so a pattern that ordinary words follow scores
  low; the support is the same for every size of table;
* patterns and instances score each other over their graph for a few rounds: a
  pattern by the share of its occurrences that are likely personal, an
  instance by the chance that one of its patterns is right;
* what identifier-like tokens good patterns point to becomes a span of the
  kind that the pattern mostly precedes. Base spans always stay.

Places are running sums over exploded matches, so a text costs in proportion
to its length however many identifiers it holds.

A pattern's kind is that of most of its seeds (ties: the first in the order
email, ip, card, phone). Null text is empty: no spans. A null doc_id is an id
like any other. Repeated rows each get their own result. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import hot_join, stage, temporaries

# The four kinds in order. A match cannot start inside a run that
# could have started it earlier (or it starts where the last match ended), and
# repeats are possessive, so that matching is linear and needs no deep stack;
# the matches are those of the plain patterns in the comments.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MOST_BITS = 1 << 20
CHUNK = 4096
PLACED = "array<struct<kind:string,start:bigint,end:bigint>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    # CASE guards the checksum from values of other lengths
    return {
        "email": F.lit(True),
        "ip": value.rlike(IP_PARTS),
        "card": F.when((n >= 13) & (n <= 19), _luhn(value)).otherwise(False),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def _before(gap: Column, i: Column) -> Column:
    """The two whole words before the token that the gap ends in, lower case; null if there are fewer. Read backwards, so that it is one match from the start."""
    backwards = F.reverse(F.concat(F.when(i == 0, " ").otherwise(""), F.lower(gap)))
    two = F.reverse(F.regexp_extract(backwards, r"^\S*+\s++(\S++\s++\S++)\s", 1))
    return F.when(two != "", F.regexp_replace(two, r"\s+", " "))


def _with_gaps(text: str, pattern: str, found: str) -> Column:
    """Of every match: how many characters lie before it since the last one, its value, and the words before."""
    parts = F.arrays_zip(F.col(found).alias("value"), F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    matches = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.length(p["gap"]).alias("gap"), p["value"].alias("value"), _before(p["gap"], i).alias("pattern")))
    return F.when(F.size(found) > 0, matches).otherwise(F.expr("cast(array() as array<struct<i:int,gap:int,value:string,pattern:string>>)"))


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and the matches of each kind and of other identifier-like tokens, valid or not."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = {**KINDS, "other": IDENTIFIER}
    # what every match holds: texts without it needn't be searched
    holds = {"email": F.contains(F.col("text"), F.lit("@")), "ip": F.rlike("text", F.lit(r"[0-9]\.[0-9]")), "card": F.rlike("text", F.lit("[0-9][\x20-]?[0-9]")), "phone": F.contains(F.col("text"), F.lit("+")), "other": F.rlike("text", F.lit("[0-9@]"))}
    none = F.expr("cast(array() as array<string>)")
    df = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    df = df.select("doc_id", "text", *[F.when(holds[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(k) for k, p in patterns.items()])
    return df.select("doc_id", F.xxhash64("text").alias("key"), *[_with_gaps("text", p, k).alias(k) for k, p in patterns.items()])


def placed(staged: DataFrame) -> DataFrame:
    """rid, kind (null for other tokens, which no base span overlaps), start, end, value, pattern."""
    tagged = lambda k: F.transform(k, lambda m: F.struct(F.lit(k).alias("kind"), m["i"].alias("i"), m["gap"].alias("gap"), m["value"].alias("value"), m["pattern"].alias("pattern")))
    rows = staged.select("rid", F.inline(F.concat(*[tagged(k) for k in (*KINDS, "other")]))).repartition("rid")
    size = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - size)
    valid = F.lit(True)
    for k in KINDS:
        valid = F.when(F.col("kind") == k, _valid(k, F.col("value"))).otherwise(valid)
    rows, other = rows.filter(valid), F.col("kind") == "other"
    # a base span overlaps a token if it starts before the token's end and ends after its start
    order = Window.partitionBy("rid").orderBy(F.when(other, F.col("end")).otherwise(F.col("start")), F.when(other, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~other, F.col("end"))).over(order)
    rows = rows.withColumn("reach", reach).filter(~other | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    return rows.select("rid", F.when(~other, F.col("kind")).alias("kind"), "start", "end", "value", "pattern")


def _wanted(keyed: DataFrame) -> Column:
    """Whether ``h`` may be a wanted hash: a bit set of bounded size, so that what surely isn't wanted is dropped as it is read."""
    size = min(MOST_BITS, 1 << max(10, (16 * keyed.count()).bit_length()))
    place = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size // 64 - 1)).cast("int")
    held = [0] * (size // 64)
    for word, bits in keyed.groupBy(place(F.col("h"))).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))"))).collect():
        held[word] = bits
    table = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")
    return F.getbit(F.get(table, place(F.col("h"))), F.col("h").bitwiseAND(F.lit(63)).cast("int")) == 1


def pattern_counts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each wanted pattern's two words occur in all texts: pairs are counted where they are read, so the join has a row per pattern."""
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+")
    pairs = documents.select(words.alias("w")).select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))))
    keyed = stage(wanted.select("pattern", F.xxhash64(F.split("pattern", " ")[0], F.split("pattern", " ")[1]).alias("h")), "pii-wanted")
    pairs = pairs.filter("b is not null").select(F.xxhash64("a", "b").alias("h")).filter(_wanted(keyed))
    return pairs.groupBy("h").agg(F.count("*").alias("occurrences")).join(keyed, "h").select("pattern", "occurrences")


def score_patterns(graph: DataFrame, counts: DataFrame, rounds: int = 3, likely: float = 0.5) -> DataFrame:
    """pattern, score after some rounds over the (pattern, value, kind, n) graph; kind is null where it isn't known."""
    edges = graph.withColumn("belief", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
    for i in range(rounds):
        heard = edges.groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.sum("n").alias("seen"), F.count_distinct(F.when(F.col("belief") > likely, F.col("value"))).alias("support"))
        scored = heard.join(counts, "pattern", "left").select("pattern", "support", (F.col("good") / (F.greatest("seen", F.coalesce("occurrences", F.lit(0))) + 1)).alias("score"))
        if i + 1 == rounds:
            return scored
        values = edges.select("value", "pattern").join(scored, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("heard"))
        edges = stage(edges.drop("heard").join(values, "value", "left").withColumn("belief", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("heard", F.lit(0.0)))).drop("heard"), "pii-edges")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def discover(documents: DataFrame, spans: DataFrame, support: int = 5, confident: float = 0.8, rounds: int = 3) -> DataFrame | None:
    """rid, kind, start, end: spans that good patterns point to; None where no pattern is induced."""
    rows = spans.filter("pattern is not null").select("kind", F.lower("value").alias("value"), "pattern")
    graph = stage(rows.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")), "pii-graph")
    # a pattern that never precedes enough different values can't become a good one
    kinds = graph.groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("pattern").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", -_rank(F.col("kind"))))).alias("kind"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("n"))
    induced = graph.groupBy("pattern").agg(F.count_distinct("value").alias("values"), F.count("kind").alias("seeds")).filter((F.col("values") >= support) & (F.col("seeds") > 0))
    induced = stage(induced.join(kinds, "pattern").select("pattern", "kind", "n"), "pii-patterns")
    if induced.isEmpty():
        return None
    counts = stage(pattern_counts(documents, induced), "pii-counts")
    scores = score_patterns(graph.join(induced.select("pattern"), "pattern"), counts, rounds)
    good = stage(scores.filter((F.col("score") >= confident) & (F.col("support") >= support)).join(induced, "pattern").select("pattern", "kind", "n"), "pii-good")
    if good.isEmpty():
        return None
    others = spans.filter("kind is null and pattern is not null").select("rid", "start", "value", "pattern")
    # closing punctuation goes, read backwards in one match
    trimmed = F.length("value") - F.length(F.regexp_extract(F.reverse("value"), r"^[\"'.,;:!?)\]>]*+", 0))
    return hot_join(others, good, ["pattern"]).filter(trimmed > 0).select("rid", "kind", "start", (F.col("start") + trimmed).alias("end"))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, key, base and spans (arrays of kind, start, end), and the counts of the base spans."""
    with temporaries() as keep:
        # matches are read once more than the result needs: it takes ids and places only
        staged = stage(base_spans(documents).withColumn("rid", F.monotonically_increasing_id()), "pii-base")
        rows = keep(stage(staged.select("rid", "doc_id", "key"), "pii-rows"))
        spans = stage(placed(staged), "pii-spans")
        every = spans.filter("kind is not null").select("rid", "kind", "start", "end", F.lit(True).alias("base"))
        found = discover(documents, spans)
        if found is not None:
            every = every.unionByName(found.withColumn("base", F.lit(False)))
        every = keep(stage(every, "pii-every"))
    every = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(_rank(F.col("kind")).alias("rank"), "start", "end", "kind", "base"))).alias("every"))
    out = rows.join(every, "rid", "left").withColumn("base", F.filter("every", lambda s: s["base"]))
    bare = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))), F.expr(f"cast(array() as {PLACED})"))
    size = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    return out.select("doc_id", "key", bare("base").alias("base"), bare("every").alias("spans"), *[F.when(F.col("base").isNull(), 0).otherwise(size(k)).cast("long").alias(f"n_{k}") for k in KINDS])


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets; n_chars follows where it was set.

    Texts with spans are masked in pieces of ``CHUNK`` characters, so that
    their cost doesn't grow with spans times length.
    """
    with temporaries() as keep:
        spans = find(documents).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "spans")
        spans = stage(spans.withColumn("mid", F.monotonically_increasing_id()), "pii-mask")
        # the row goes as one column: no name of its own can clash
        keyed = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.col("text").cast("string").alias("text"))
        # both sides null-safe: a row without an id keeps its spans
        same = F.col("d.key").eqNullSafe(F.col("s.key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
        texts = keyed.drop("row").alias("d").join(spans.alias("s").hint("merge"), same).select("s.mid", "d.text").dropDuplicates(["mid"])
        pieces = texts.select("mid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("c", "piece"))
        earlier = Window.partitionBy("mid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
        parts = spans.select("mid", F.inline("spans")).withColumn("at", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        # spans that overlap go as one, under the first one's kind
        parts = parts.select("mid", F.greatest("start", "at").alias("lo"), F.col("end").alias("hi"), F.when(F.col("start") >= F.col("at"), F.concat(F.lit("<"), "kind", F.lit(">"))).otherwise("").alias("label")).filter("hi > lo")
        c = lambda place: F.floor(place / CHUNK).cast("int")
        parts = parts.select("*", F.explode(F.sequence(c(F.col("lo")), c(F.col("hi") - 1))).alias("c"))
        inside = F.struct((F.greatest("lo", F.col("c") * CHUNK) - F.col("c") * CHUNK).cast("int").alias("lo"), (F.least("hi", (F.col("c") + 1) * CHUNK) - F.col("c") * CHUNK).cast("int").alias("hi"), F.when(c(F.col("lo")) == F.col("c"), F.col("label")).otherwise("").alias("label"))
        parts = parts.groupBy("mid", "c").agg(F.sort_array(F.collect_list(inside)).alias("parts"))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def put(acc: Column, p: Column) -> Column:
            return F.struct(p["hi"].alias("at"), F.concat(acc["out"], F.substring("piece", acc["at"] + 1, p["lo"] - acc["at"]), p["label"]).alias("out"))

        masked = F.when(F.col("parts").isNull(), F.col("piece")).otherwise(F.aggregate("parts", start, put, lambda acc: F.concat(acc["out"], F.substring("piece", acc["at"] + 1, F.lit(CHUNK)))))
        masked = pieces.join(parts, ["mid", "c"], "left").select("mid", F.struct("c", masked.alias("piece")).alias("piece"))
        masked = masked.groupBy("mid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["piece"]), "").alias("_text"))
        masked = keep(stage(masked.join(spans.select("mid", "doc_id", "key"), "mid").select("doc_id", "key", "_text"), "pii-masked"))
    rows = keyed.select("row", "doc_id", "key").alias("d").join(masked.alias("s").hint("merge"), same, "left").select("row", "_text")
    old = lambda c: F.col("row")[c]
    out = {c: old(c) for c in documents.columns}
    out["text"] = F.coalesce("_text", old("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_text").isNotNull() & old("n_chars").isNotNull(), F.length("_text").cast("long")).otherwise(old("n_chars"))
    return rows.select(*[c.alias(name) for name, c in out.items()])
