"""Registered queries over the star schema and the event stream, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions import scalar
from gridloom.operators import bitplanes, blocks, coding, fields, measures, quantities, series
from gridloom.plans.grid import Halving

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- norms, tolerances, errors ---------------------------------------------------------------


@query("select l_returnflag, round(max(abs(l_extendedprice)), 6) as linf from lineitem group by l_returnflag")
def norm_linf(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(measures.linf("l_extendedprice"), "linf"))


@query("select l_returnflag, round(sqrt(sum(l_quantity * l_quantity) / count(*)), 6) as rms from lineitem group by l_returnflag")
def norm_rms(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(measures.rms("l_quantity"), "rms"))


_SERIES = """
    s as (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i, value as v,
                 cast(count(*) over (partition by user_id) as bigint) as n from events),
    g as (select * from s where n >= 3)"""


def _events(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"))
    rows = rows.withColumn("i", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    return rows.filter("n >= 3").select("user_id", "i", "n", "v")


@query(f"""
    with {_SERIES},
    m as (select *, 1.0 / (n - 1) as h, lag(v) over w as a, lead(v) over w as b from g window w as (partition by user_id order by i))
    select user_id, round(sqrt(sum(v * (h / 6 * coalesce(a, 0) + h / 6 * coalesce(b, 0)
           + h / 3 * v * ((a is not null)::int + (b is not null)::int)))), 6) as l2 from m group by user_id""")
def norm_l2_series(spark, d):
    rows = series.mass_stencil(_events(spark, d), "user_id", "i", "v", 1 / (F.col("n") - 1))
    return rows.groupBy("user_id").agg(r6(F.sqrt(F.sum(F.col("v") * F.col("mv"))), "l2"))


@query("""
    with b as (select l_returnflag, l_orderkey % 16 as blk, sqrt(sum(l_tax * l_tax)) as norm from lineitem group by all)
    select l_returnflag, round(sqrt(sum(norm * norm)), 6) as norm, round(sqrt(1e-6 / count(*)), 9) as local_tol from b group by l_returnflag""")
def block_norm_combine(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 16).alias("blk")).agg(F.sqrt(F.sum(F.col("l_tax") * F.col("l_tax"))).alias("norm"))
    return b.groupBy("l_returnflag").agg(r6(F.sqrt(F.sum(F.col("norm") * F.col("norm"))), "norm"), F.round(measures.local_tolerance(F.lit(1e-3), F.count("*"), 0.0), 9).alias("local_tol"))


_Q = "cast(sign(l_extendedprice) * floor(abs(l_extendedprice / 12.5) + 0.5) as bigint)"


def _quantized(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("q", scalar.quantized(F.col("l_extendedprice"), F.lit(12.5)))


@query(f"select l_orderkey, l_linenumber, {_Q} as q from lineitem")
def linear_quantize(spark, d):
    return _quantized(spark, d).select("l_orderkey", "l_linenumber", "q")


@query(f"""
    with e as (select l_returnflag, l_extendedprice as x, {_Q} * 12.5 as y from lineitem)
    select l_returnflag, round(max(abs(x - y)), 6) as linf_err, round(avg((x - y) * (x - y)), 6) as mse,
           round(20 * log10((max(x) - min(x)) / sqrt(avg((x - y) * (x - y)))), 6) as psnr,
           round(sqrt(avg((x - y) * (x - y))) / (max(x) - min(x)), 9) as nrmse from e group by l_returnflag""")
def quantize_error(spark, d):
    e = measures.errors(_quantized(spark, d).withColumn("y", F.col("q") * 12.5), ["l_returnflag"], "l_extendedprice", "y")
    return e.select("l_returnflag", r6("linf_err", "linf_err"), r6("mse", "mse"), r6("psnr", "psnr"), F.round("nrmse", 9).alias("nrmse"))


@query(f"""
    with e as (select l_orderkey, l_linenumber, {_Q} as q from lineitem)
    select l_orderkey, l_linenumber, case when q + 2048 between 0 and 4095 then q + 2048 else 0 end as symbol,
           case when q + 2048 between 0 and 4095 then 0 else q end as outlier, q as restored from e""")
def outlier_split(spark, d):
    rows = measures.split_outliers(_quantized(spark, d), "q", 4096)
    return rows.select("l_orderkey", "l_linenumber", "symbol", F.coalesce("outlier", F.lit(0)).alias("outlier"), measures.restored(F.col("symbol"), F.col("outlier"), 4096).alias("restored"))


@query("select l_returnflag, cast(l_quantity as bigint) as q, count(*) as n from lineitem group by all")
def histogram(spark, d):
    return measures.histogram(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), ["l_returnflag"], "q")


@query("""
    with c as (select l_returnflag, cast(l_quantity as bigint) as q, count(*) as n from lineitem group by all),
    t as (select *, n / sum(n) over (partition by l_returnflag) as p from c)
    select l_returnflag, round(-sum(p * log2(p)), 6) as bits, cast(sum(n) as bigint) as total, count(*) as symbols from t group by l_returnflag""")
def entropy(spark, d):
    e = measures.entropy(histogram(spark, d), ["l_returnflag"])
    return e.select("l_returnflag", r6("bits", "bits"), "total", "symbols")


@query()
def huffman_code_length(spark, d):
    """Average code length per flag: at least the entropy, and less than a bit above it."""

    def one(pdf):
        n = pdf["n"].to_numpy()
        return pdf[["l_returnflag"]].iloc[:1].assign(bits=float((n * coding.code_lengths(n)).sum() / n.sum()))

    return histogram(spark, d).groupBy("l_returnflag").applyInPandas(one, "l_returnflag string, bits double")


# --- levels and layout -------------------------------------------------------------------------

_LEVELS = f"""
    {_SERIES},
    k as (select *, length(bin(n - 1)) - 1 as ldy from g),
    l as (select *, coalesce(list_min(list_filter(range(0, ldy + 1), lambda l: (((i * (1 << l) + n - 2) // (n - 1)) * (n - 1)) // (1 << l) = i)),
                             ldy + case when (1 << ldy) + 1 = n then 0 else 1 end) as lvl from k),
    j as (select *, (i * (1 << greatest(lvl - 1, 0)::bigint) + n - 2) // (n - 1) as jr, 1 << greatest(lvl - 1, 0)::bigint as m from l),
    x as (select user_id, n, i, v, cast(lvl as int) as lvl, case when lvl > 0 then ((jr - 1) * (n - 1)) // m end as il, case when lvl > 0 then (jr * (n - 1)) // m end as ir from j),
    c as (select x.*, case when x.lvl > 0 then a.v + (x.i - x.il) / (x.ir - x.il)::double * (b.v - a.v) else 0 end as interp
          from x left join g a on a.user_id = x.user_id and a.i = x.il left join g b on b.user_id = x.user_id and b.i = x.ir)"""


def _nodes(spark, d) -> DataFrame:
    return series.nodes(series.to_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"), "user_id")


@query(f"with {_LEVELS} select user_id, i, lvl from x")
def date_of_birth(spark, d):
    return _nodes(spark, d).select("user_id", "i", "lvl")


@query(f"with {_LEVELS} select lvl, count(*) as nodes, count(distinct user_id) as fields from x group by lvl")
def level_counts(spark, d):
    return _nodes(spark, d).groupBy("lvl").agg(F.count("*").alias("nodes"), F.count_distinct("user_id").alias("fields"))


@query(f"with {_LEVELS} select user_id, i, cast(row_number() over (partition by user_id order by lvl, i) - 1 as bigint) as pos from x")
def shuffle_order(spark, d):
    w = Window.partitionBy("user_id").orderBy("lvl", "i")
    return _nodes(spark, d).select("user_id", "i", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query(f"with {_LEVELS} select user_id, lvl, i, cast(row_number() over (partition by user_id, lvl order by i) - 1 as bigint) as pos from x")
def level_linear_order(spark, d):
    w = Window.partitionBy("user_id", "lvl").orderBy("i")
    return _nodes(spark, d).select("user_id", "lvl", "i", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query(f"with {_LEVELS} select user_id, i, il, ir from x where lvl > 0")
def introducing_neighbours(spark, d):
    return _nodes(spark, d).filter("lvl > 0").select("user_id", "i", "il", "ir")


@query("select l_orderkey // 512 as block_id, count(*) as nodes, min(l_orderkey) as lo, max(l_orderkey) as hi from lineitem group by 1")
def domain_blocks(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 512).alias("block_id")).agg(F.count("*").alias("nodes"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


# --- transforms ----------------------------------------------------------------------------------


@query(f"with {_LEVELS} select user_id, i, round(interp, 6) as interp from c where lvl > 0")
def prolongation_interp(spark, d):
    return series.hierarchical(_nodes(spark, d)).filter("lvl > 0").select("user_id", "i", r6("interp", "interp"))


@query(f"with {_LEVELS} select user_id, i, lvl, round(v - interp, 6) as coef from c")
def hier_coefficients(spark, d):
    return series.hierarchical(_nodes(spark, d)).select("user_id", "i", "lvl", r6("coef", "coef"))


@query(f"""with {_SERIES} select user_id, i, round(h / 6 * coalesce(lag(v) over w, 0) + ((i > 0)::int + (i < n - 1)::int) * h / 3 * v + h / 6 * coalesce(lead(v) over w, 0), 9) as mv
        from (select *, 1::double / (n - 1) as h from g) window w as (partition by user_id order by i)""")
def mass_stencil(spark, d):
    rows = series.mass_stencil(_events(spark, d), "user_id", "i", "v", 1 / (F.col("n") - 1))
    return rows.select("user_id", "i", F.round("mv", 9).alias("mv"))


@query(f"""with {_SERIES}, w as (select *, case when i % 2 = 1 then v / 2 else 0 end as share from g),
        r as (select *, v + coalesce(lag(share) over o, 0) + coalesce(lead(share) over o, 0) as rv from w window o as (partition by user_id order by i))
        select user_id, i, round(rv, 6) as rv from r where i % 2 = 0""")
def restriction(spark, d):
    return series.restricted(_events(spark, d), "user_id", "i", "v", F.col("i") % 2 == 1).select("user_id", "i", r6("rv", "rv"))


def projection(n: int, halving: bool = False) -> np.ndarray:
    """The orthogonal decomposition of ``n`` nodes as a matrix, by its formula: level by level u - P u_c, and u_c + (P'MP)^-1 P'M (u - P u_c)."""
    x, out = np.arange(n) / max(1, n - 1), np.eye(n)
    if halving:
        sets = [list(range(n))]
        while len(sets[0]) > 2:
            sets.insert(0, sorted({*sets[0][::2], n - 1}))
    else:
        power = (n - 1).bit_length() - 1 if n > 1 else 0
        sets = [[j * (n - 1) // 2**k for j in range(2**k + 1)] for k in range(power + 1)] if n > 1 else [[0]]
        sets += [list(range(n))] * (len(sets[-1]) < n)
    for coarse, fine in list(zip(sets, sets[1:], strict=False))[::-1]:
        up = np.stack([np.interp(x[fine], x[coarse], e) for e in np.eye(len(coarse))], 1)
        h, m = np.diff(x[fine]), np.zeros((len(fine), len(fine)))
        for k, w in enumerate(h):
            m[k : k + 2, k : k + 2] += w / 6 * np.array([[2, 1], [1, 2]])
        at = [fine.index(j) for j in coarse]
        u = out[fine]
        detail = u - up @ u[at]
        detail[at] = u[at] + np.linalg.solve(up.T @ m @ up, up.T @ m @ detail)
        out[fine] = detail
    return out


def _matrices(most: int, halving: bool = False) -> str:
    return ", ".join(f"({n}, {i}, {j}, {float(v)!r}::double)" for n in range(1, most + 1) for (i, j), v in np.ndenumerate(projection(n, halving)))


def _block_sql(size: int, halving: bool = False) -> str:
    return f"""
    p as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag, l_orderkey // 64 order by l_orderkey, l_linenumber, l_extendedprice) - 1 as pos, l_orderkey // 64 as grp from lineitem),
    b as (select l_returnflag, grp, pos // {size} as blk, pos % {size} as c, v, count(*) over (partition by l_returnflag, grp, pos // {size}) as n from p),
    m(n, r, c, a) as (values {_matrices(size, halving)})"""


def _price_blocks(spark, d, size: int) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("grp", F.floor(F.col("l_orderkey") / 64))
    rows = fields.number_in_blocks(rows, ["l_returnflag", "grp"], ["l_orderkey", "l_linenumber", "l_extendedprice"], size)
    rows = rows.groupBy("l_returnflag", "grp", F.col("block").alias("blk")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("l_extendedprice").alias("v")))).alias("r"))
    return rows.select("l_returnflag", "grp", "blk", F.transform("r", lambda x: x["v"]).alias("data"))


def _quantized_blocks(rows: DataFrame) -> DataFrame:
    rows = rows.select("l_returnflag", "grp", "blk", F.posexplode("data").alias("i", "c"))
    return rows.select("l_returnflag", "grp", "blk", "i", scalar.quantized(F.col("c"), F.lit(0.7310585)).alias("coef"))


_COEFS = "select l_returnflag, grp, blk, r as i, cast(sign(sum(a * v)) * floor(abs(sum(a * v) / 0.7310585) + 0.5) as bigint) as coef from b join m using (n, c) group by all"


@query(f"with {_block_sql(9)} {_COEFS}")
def orthogonal_decompose(spark, d):
    """Orthogonal coefficients of blocks of up to nine nodes, the last ones shorter; the SQL has the projections' formula."""
    return _quantized_blocks(fields.linear_blocks(_price_blocks(spark, d, 9), blocks.decompose))


@query(f"with {_block_sql(10, True)} {_COEFS}")
def halving_decompose(spark, d):
    """The same on the halving hierarchy, where blocks of even sizes keep their last node on every level."""
    return _quantized_blocks(fields.linear_blocks(_price_blocks(spark, d, 10), lambda u: blocks.decompose(u, kind=Halving)))


@query(f"with {_block_sql(9)} select l_returnflag, grp, blk, round(max(v), 4) as top, 0.0::double as worst from b group by all")
def orthogonal_roundtrip(spark, d):
    """Values that come back from their coefficients: the largest one, and the worst error."""
    rows = _price_blocks(spark, d, 9)
    there = fields.linear_blocks(rows.withColumn("back", F.col("data")), blocks.decompose, "back")
    back = fields.linear_blocks(there, blocks.recompose, "back")
    return back.select("l_returnflag", "grp", "blk", F.round(F.array_max("back"), 4).alias("top"), F.round(F.array_max(F.zip_with("data", "back", lambda a, b: F.abs(a - b))), 6).alias("worst"))


_TAU = 5.0
_HQ = f"""
    {_LEVELS},
    t as (select *, cast(sign(v - interp) * floor(abs((v - interp) / (2 * {_TAU} / ((length(bin(n - 1)) + case when (1 << (length(bin(n - 1)) - 1)) + 1 = n then 0 else 1 end) * 4))) + 0.5) as bigint) as q from c)"""


def _hier_quantized(spark, d) -> DataFrame:
    quantum = measures.supremum_quantum(_TAU, series.last_level(F.col("n")), 1)
    rows = series.hierarchical(_nodes(spark, d)).withColumn("quantum", quantum)
    return rows.withColumn("q", scalar.quantized(F.col("coef"), F.col("quantum")))


@query(f"""with {_HQ}, h as (select q, count(*) as n from t group by q)
    select round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as bits, cast(sum(n) as bigint) as total, count(*) as symbols from h""")
def hier_quantize_entropy(spark, d):
    """Bits a value that the event series need within the tolerance: level, coefficient, quantize, count, entropy."""
    e = measures.entropy(measures.histogram(_hier_quantized(spark, d), [], "q"), [])
    return e.select(r6("bits", "bits"), "total", "symbols")


@query(f"with {_SERIES} select user_id, true as within from g group by user_id")
def hier_roundtrip_error(spark, d):
    """Decoded series stay within the tolerance of the originals."""
    rows = _hier_quantized(spark, d)
    back = series.rebuild(rows.withColumn("decoded", F.col("q") * F.col("quantum")), "user_id")
    return rows.select("user_id", "i", F.col("v").alias("x")).join(back, ["user_id", "i"]).groupBy("user_id").agg((F.max(F.abs(F.col("x") - F.col("v"))) <= _TAU).alias("within"))


@query(f"""with {_LEVELS} select user_id, lvl, round(2 * 0.01 / (power(2.0, 0.5 * lvl) * sqrt(max(n))), 9) as quantum from x group by user_id, lvl""")
def level_quanta(spark, d):
    return _nodes(spark, d).groupBy("user_id", "lvl").agg(F.max("n").alias("n")).select("user_id", "lvl", F.round(measures.level_quantum(0.01, 0.5, F.col("lvl"), F.col("n")), 9).alias("quantum"))


@query("""
    with e as (select vec_id, unnest(embedding[1:64])::double as x, generate_subscripts(embedding[1:64], 1) - 1 as i from embeddings),
    t as (select vec_id, i // 8 as tile, i % 8 as k, x from e),
    p as (select a.vec_id, a.tile, l.lag, sum(a.x * b.x) / sum(a.x * a.x) as r from t a cross join (values (1), (2), (3)) l(lag) join t b on b.vec_id = a.vec_id and b.tile = a.tile and b.k = (a.k + l.lag) % 8 group by all)
    select lag, round(avg(r), 6) as autocorrelation from p group by lag""")
def tile_autocorrelation(spark, d):
    """Circular autocorrelation of eight-node lines, averaged: a rotation of each line's array, no join."""
    tiles = table(spark, d, "embeddings").select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding"), t * 8 + 1, F.lit(8)))).alias("x"))
    tiles = tiles.select(F.transform("x", lambda v: v.cast("double")).alias("x"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("lag"))
    turned = F.concat(F.slice("x", F.col("lag") + 1, F.lit(8)), F.slice("x", F.lit(1), F.col("lag")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return tiles.groupBy("lag").agg(r6(F.avg(dot("x", turned) / dot("x", "x")), "autocorrelation"))


# --- bit planes and plans --------------------------------------------------------------------------

_FP = """
    w as (select l_returnflag, l_linenumber as lvl, l_orderkey, l_extendedprice - 50000 as v from lineitem),
    e as (select l_returnflag, lvl, cast(floor(log2(max(abs(v)))) + 1 as int) as exp from w group by all),
    f as (select w.*, e.exp, cast(least(floor(abs(v) * power(2.0, 16 - exp)), 65535) as bigint) as fp from w join e using (l_returnflag, lvl))"""


def _fixed(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("lvl"), "l_orderkey", (F.col("l_extendedprice") - 50000).alias("coef"))
    exps = bitplanes.level_exponents(rows, ["l_returnflag", "lvl"])
    return rows.join(exps, ["l_returnflag", "lvl"]).withColumn("fp", bitplanes.fixed_point(F.col("coef"), F.col("exp"), 16))


@query(f"with {_FP} select * from e")
def level_exponent(spark, d):
    return _fixed(spark, d).groupBy("l_returnflag", "lvl").agg(F.max("exp").alias("exp"))


@query(f"""with {_FP} select l_returnflag, lvl, l_orderkey // 32 as block, p as bitplane, cast(sum(((fp >> (15 - p)) & 1) << (l_orderkey % 32)) as bigint) as word
    from f, (select cast(unnest(range(0, 16)) as int) as p) group by all""")
def bitplane_words(spark, d):
    return bitplanes.words(_fixed(spark, d), ["l_returnflag", "lvl"], F.floor(F.col("l_orderkey") / 32), (F.col("l_orderkey") % 32).cast("int"), 16)


@query(f"""with {_FP}, k as (select f.*, kept, abs(v) - (fp >> (16 - kept)) * power(2.0, exp - kept) as d from f, (select cast(unnest(range(0, 17)) as int) as kept))
    select l_returnflag, lvl, kept, round(sum(d * d) / 1e6, 2) as sq_err, round(max(d), 6) as max_err from k group by all""")
def bitplane_errors(spark, d):
    e = bitplanes.truncation_errors(_fixed(spark, d), ["l_returnflag", "lvl"], 16)
    return e.select("l_returnflag", "lvl", "kept", F.round(F.col("sq_err") / 1e6, 2).alias("sq_err"), r6("max_err", "max_err"))


@query("""select event_id, xor(q + 3074457345618258602, 3074457345618258602) as nb, q as back from (select event_id, cast(floor(value * 8) as bigint) - 400 as q from events)""")
def negabinary(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.floor(F.col("value") * 8) - 400).cast("long").alias("q"))
    return rows.select("event_id", scalar.to_negabinary(F.col("q")).alias("nb"), scalar.from_negabinary(scalar.to_negabinary(F.col("q"))).alias("back"))


_GAINS = f"""{_FP}, k as (select l_returnflag, lvl, kept, sum(power(abs(v) - (fp >> (16 - kept)) * power(2.0, exp - kept), 2)) as e from f, (select cast(unnest(range(0, 17)) as int) as kept) group by all),
    a as (select x.l_returnflag, x.lvl, x.kept as bitplane, x.e - y.e as gain from k x join k y on x.l_returnflag = y.l_returnflag and x.lvl = y.lvl and y.kept = x.kept + 1),
    t as (select l_returnflag, sum(e) as total from k where kept = 0 group by all)"""


def _plan_sql(order: str) -> str:
    return f"""with {_GAINS}, p as (select a.*, total, total - coalesce(sum(gain) over (partition by l_returnflag order by {order} rows between unbounded preceding and 1 preceding), 0) as before from a join t using (l_returnflag))
        select l_returnflag, lvl, bitplane from p where before >= 1e-3 * total"""


def _planned(spark, d, order: list[str]) -> DataFrame:
    e = bitplanes.truncation_errors(_fixed(spark, d), ["l_returnflag", "lvl"], 16)
    gain = F.col("sq_err") - F.lead("sq_err").over(Window.partitionBy("l_returnflag", "lvl").orderBy("kept"))
    planes = e.withColumn("gain", gain).withColumnRenamed("kept", "bitplane")
    total = e.filter("kept = 0").groupBy("l_returnflag").agg(F.sum("sq_err").alias("sum0"))
    # errors relative to each field's own, so that one tolerance serves all
    planes = planes.filter("gain is not null").join(total, "l_returnflag").withColumn("gain", F.col("gain") / F.col("sum0")).withColumn("total", F.lit(1.0))
    return measures.plan_planes(planes, order, ["l_returnflag"], 1e-3).select("l_returnflag", "lvl", "bitplane")


@query(_plan_sql("lvl, bitplane"))
def inorder_plan(spark, d):
    return _planned(spark, d, ["lvl", "bitplane"])


@query(_plan_sql("bitplane, lvl"))
def roundrobin_plan(spark, d):
    return _planned(spark, d, ["bitplane", "lvl"])


def _long_series(spark, d) -> DataFrame:
    return fields.to_blocks(table(spark, d, "events").filter("user_id is not null"), "user_id", ["ts", "event_id"], "value").filter(F.size("data") >= 3)


@query()
def greedy_plan(spark, d):
    return fields.request(fields.refactor(_long_series(spark, d)), 1.0)


@query(f"with {_SERIES} select user_id as block_id, true as better from g group by all")
def progressive_refine(spark, d):
    """A second request adds to the first's result, and the error falls."""
    data = _long_series(spark, d)
    fragments = fields.refactor(data)
    first, second = fields.request(fragments, 10.0), fields.request(fragments, 0.1)
    one = fields.refine(fragments, first)
    two = fields.added(data.select("block_id", F.transform("data", lambda x: x * 0).alias("data")).join(one.withColumnRenamed("data", "o"), "block_id", "left").select("block_id", F.coalesce("o", "data").alias("data")), fields.refine(fragments, second, first))
    worst = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    rows = data.join(one.withColumnRenamed("data", "o"), "block_id", "left").join(two.withColumnRenamed("data", "t"), "block_id")
    return rows.select("block_id", (worst("data", "t") <= F.coalesce(worst("data", "o"), F.lit(1e300)) + 1e-9).alias("better"))


# --- regions and quantities of interest ------------------------------------------------------------

_ROI = f"""{_LEVELS},
    a as (select user_id, i // 8 as block, sum(case when lvl > 0 then abs(v - interp) else 0 end) / count(*) as activity from c group by all),
    r as (select *, row_number() over (partition by user_id order by round(activity, 9) desc, block) as k, count(*) over (partition by user_id) as nb from a),
    kept as (select user_id, block from r where k <= ceil(0.2 * nb)),
    z as (select c.*, coalesce((select min(case when greatest(k.block * 8 - c.i, c.i - k.block * 8 - 7, 0) = 0 then 0 when greatest(k.block * 8 - c.i, c.i - k.block * 8 - 7, 0) <= 4 then 125 else 255 end)
                                from kept k where k.user_id = c.user_id), 255) as zone from c)"""


def _roi_blocks(spark, d) -> DataFrame:
    a = quantities.block_activity(series.hierarchical(_nodes(spark, d)), ["user_id"], F.floor(F.col("i") / 8), "lvl", "coef")
    return quantities.top_fraction(a.withColumn("activity", F.round("activity", 9)), ["user_id"], 0.2).select("user_id", "block")


@query(f"with {_ROI} select * from kept")
def block_topk_roi(spark, d):
    return _roi_blocks(spark, d)


@query(f"with {_ROI} select user_id, i, cast(zone as int) as zone from z")
def buffer_zone(spark, d):
    nodes = _nodes(spark, d).select("user_id", "i")
    return quantities.zones(nodes, _roi_blocks(spark, d), ["user_id"], 8, 4)


@query(f"""with {_ROI} select user_id, i, cast(case when zone = 255 then 23 * sign(v - interp) * floor(abs((v - interp) / (0.25 * 23)) + 0.5) else sign(v - interp) * floor(abs((v - interp) / 0.25) + 0.5) end as bigint) as q from z""")
def roi_quantize(spark, d):
    nodes = series.hierarchical(_nodes(spark, d)).select("user_id", "i", "coef")
    z = quantities.zones(nodes, _roi_blocks(spark, d), ["user_id"], 8, 4)
    return z.select("user_id", "i", quantities.roi_quantized(F.col("coef"), F.lit(0.25), F.col("zone"), 23).alias("q"))


@query("select o_orderpriority, round(avg(o_totalprice), 4) as box_avg from orders where o_orderkey % 100 between 10 and 39 group by all")
def box_average_qoi(spark, d):
    rows = table(spark, d, "orders").filter((F.col("o_orderkey") % 100).between(10, 39))
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("box_avg"))


@query("""
    with m as (select l_suppkey, sum(l_quantity * l_tax) as d, sum(l_quantity * l_tax * l_discount) as m1, sum(l_quantity * l_tax * l_discount * l_discount) as m2 from lineitem group by all)
    select l_suppkey, round(d, 6) as density, round(m1 / d, 6) as mean_velocity, round(m2 / d - (m1 / d) * (m1 / d), 6) as temperature from m where d > 0""")
def moments(spark, d):
    m = quantities.moments(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"))
    return m.filter("density > 0").select("l_suppkey", r6("density", "density"), r6("mean_velocity", "mean_velocity"), r6("temperature", "temperature"))


@query("""with s as (select o_custkey, avg(o_totalprice) as m from orders group by all),
    x as (select c_nationkey, c_custkey as o_custkey, 1.0 / count(*) over (partition by c_nationkey) as wgt from customer)
    select c_nationkey, round(sum(wgt * m), 4) as m from x join s using (o_custkey) group by all""")
def surface_average(spark, d):
    """Average over surfaces as a sparse matrix times a vector."""
    vector = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    matrix = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("o_custkey"), (1 / F.count("*").over(Window.partitionBy("c_nationkey"))).alias("wgt"))
    return quantities.sparse_times(matrix, vector, "c_nationkey", "o_custkey", "wgt", "m").select("c_nationkey", F.round("m", 4).alias("m"))


@query("""select event_id, round(value - avg(value) over (partition by user_id, event_type), 6) as turbulent from events""")
def average_split(spark, d):
    """The part that the average over planes leaves."""
    w = Window.partitionBy("user_id", "event_type")
    return table(spark, d, "events").select("event_id", r6(F.col("value") - F.avg("value").over(w), "turbulent"))


@query()
def moment_correction(spark, d):
    rows = _events(spark, d).select("user_id", "i", (F.abs("v") + 1).alias("exact"))
    rows = rows.withColumn("approx", F.greatest(F.round(F.col("exact") / 4) * 4, F.lit(0.5)))
    return quantities.corrected(rows, "user_id").select("user_id", "before", "after")


@query("""select c_custkey, case when abs(c_acctbal - 0) <= abs(c_acctbal - 2500) and abs(c_acctbal) <= abs(c_acctbal - 7500) then 0.0::double when abs(c_acctbal - 2500) <= abs(c_acctbal - 7500) then 2500.0::double else 7500.0::double end as centre from customer""")
def nearest_centroid(spark, d):
    return quantities.nearest(table(spark, d, "customer"), "c_acctbal", [0.0, 2500.0, 7500.0]).select("c_custkey", "centre")


@query("""with recursive l(step, a, b, c, e, moved) as (
        select 0, min(c_acctbal), min(c_acctbal) + (max(c_acctbal) - min(c_acctbal)) / 3, min(c_acctbal) + 2 * (max(c_acctbal) - min(c_acctbal)) / 3, max(c_acctbal), 1e9 from customer
        union all
        select any_value(step) + 1, coalesce(avg(x) filter (k = 0), any_value(a)), coalesce(avg(x) filter (k = 1), any_value(b)), coalesce(avg(x) filter (k = 2), any_value(c)), coalesce(avg(x) filter (k = 3), any_value(e)),
               greatest(abs(coalesce(avg(x) filter (k = 0), any_value(a)) - any_value(a)), abs(coalesce(avg(x) filter (k = 1), any_value(b)) - any_value(b)), abs(coalesce(avg(x) filter (k = 2), any_value(c)) - any_value(c)), abs(coalesce(avg(x) filter (k = 3), any_value(e)) - any_value(e)))
        from (select l.*, c_acctbal as x, case when abs(c_acctbal - a) <= abs(c_acctbal - b) then 0 when abs(c_acctbal - b) <= abs(c_acctbal - c) then 1 when abs(c_acctbal - c) <= abs(c_acctbal - e) then 2 else 3 end as k from l, customer where moved >= 1e-4 and step < 1000)
        having count(*) > 0),
    z as (select * from l where step = (select max(step) from l)),
    n as (select case when abs(c_acctbal - a) <= abs(c_acctbal - b) then a when abs(c_acctbal - b) <= abs(c_acctbal - c) then b when abs(c_acctbal - c) <= abs(c_acctbal - e) then c else e end as centre from z, customer)
    select round(centre, 3) as centre, count(*) as n from n group by all""")
def kmeans_values(spark, d):
    """Lloyd's rounds from four evenly spaced centres, and how many values go to each."""
    rows = table(spark, d, "customer")
    centres = quantities.lloyd(rows, "c_acctbal", 4)
    return quantities.nearest(rows, "c_acctbal", centres).groupBy(F.round("centre", 3).alias("centre")).agg(F.count("*").alias("n"))


# --- contours and meshes ------------------------------------------------------------------------------


def _grid(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))


@query("""
    with g as (select vec_id as r, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as c from embeddings),
    b as (select r, c, (v >= 0.05)::int as s from g)
    select a.r, cast(a.c as int) as c, cast(a.s + 2 * x.s + 4 * y.s + 8 * z.s as int) as case_id from b a join b x on x.r = a.r and x.c = a.c + 1 join b y on y.r = a.r + 1 and y.c = a.c join b z on z.r = a.r + 1 and z.c = a.c + 1""")
def iso_edge_cases(spark, d):
    return quantities.square_cases(_grid(spark, d), 0.05)


@query("""
    with g as (select vec_id, vec_id // 4 as blk, unnest(embedding)::double as v from embeddings)
    select blk, round(min(v), 6) as lo, round(max(v), 6) as hi from g group by blk having max(v) + 0.01 >= 0.4 and min(v) - 0.01 <= 0.4""")
def iso_blocks_kept(spark, d):
    """Blocks that a level surface may cross, given the error bound: data skipping by statistics."""
    rows = _grid(spark, d).groupBy(F.floor(F.col("r") / 4).alias("blk")).agg(F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))
    return rows.filter((F.col("hi") + 0.01 >= 0.4) & (F.col("lo") - 0.01 <= 0.4)).select("blk", r6("lo", "lo"), r6("hi", "hi"))


_TRI = "t as (select o_orderkey as element, [(o_custkey % 97)::int, 97 + (o_orderkey % 89)::int, 186 + (o_custkey % 83)::int] as nodes from orders), p as (select k::int as node, (k * 37 % 101)::double as x, (k * 53 % 103)::double as y from range(0, 269) r(k))"


def _triangles(spark, d) -> DataFrame:
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(o.alias("element"), F.array((k % 97).cast("int"), (97 + o % 89).cast("int"), (186 + k % 83).cast("int")).alias("nodes"))


def _points(spark) -> DataFrame:
    return spark.range(269).select(F.col("id").cast("int").alias("node"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 103).cast("double").alias("y"))


def _measured(spark, d) -> DataFrame:
    rows = _triangles(spark, d)
    for k in range(3):
        # the table of points is small, and Spark knows its size
        corner = _points(spark).select(F.col("node").alias(f"_n{k}"), F.struct("x", "y").alias(f"_p{k}"))
        rows = rows.join(corner, F.col("nodes")[k] == F.col(f"_n{k}"))
    return rows.select("element", "nodes", quantities.triangle_area(F.col("_p0"), F.col("_p1"), F.col("_p2")).alias("measure"))


@query(f"with {_TRI} select distinct least(u, w) as a, greatest(u, w) as b from (select unnest([nodes[1], nodes[1], nodes[2]]) as u, unnest([nodes[2], nodes[3], nodes[3]]) as w from t)")
def distinct_edges(spark, d):
    return quantities.edges_of(_triangles(spark, d))


@query(f"with {_TRI}, e as (select distinct unnest([nodes[1], nodes[1], nodes[2]]) as a, unnest([nodes[2], nodes[3], nodes[3]]) as b from t) select a, b, (u.x + w.x) / 2 as mx, (u.y + w.y) / 2 as my from e join p u on u.node = a join p w on w.node = b")
def edge_midpoints(spark, d):
    pts = _points(spark)
    e = quantities.edges_of(_triangles(spark, d)).join(pts.toDF("a", "ax", "ay"), "a").join(pts.toDF("b", "bx", "by"), "b")
    return e.select("a", "b", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))


_AREA = f"{_TRI}, m as (select element, nodes, abs((q.x - p0.x) * (r.y - p0.y) - (r.x - p0.x) * (q.y - p0.y)) / 2 as measure from t join p p0 on p0.node = nodes[1] join p q on q.node = nodes[2] join p r on r.node = nodes[3])"


@query(f"with {_AREA} select element, measure from m")
def element_measure(spark, d):
    return _measured(spark, d).select("element", "measure")


@query(f"""with {_AREA}, f as (select element, measure, unnest(nodes) as node from m), v as (select node, x * 0.5 - y as v from p),
    s as (select f.*, v.v, sum(v.v) over (partition by element) as total from f join v using (node))
    select node, round(sum(measure / 12 * (total + v)), 4) as mv from s group by node""")
def mesh_mass(spark, d):
    values = _points(spark).select("node", (F.col("x") * 0.5 - F.col("y")).alias("v"))
    return quantities.mesh_mass(_measured(spark, d), values).select("node", F.round("mv", 4).alias("mv"))


@query(f"""with {_TRI}, m as (select element, nodes[1]::varchar as a, nodes[2]::varchar as b, nodes[3]::varchar as c, least(nodes[1]::varchar, nodes[2]::varchar) || '-' || greatest(nodes[1]::varchar, nodes[2]::varchar) as ab,
        least(nodes[1]::varchar, nodes[3]::varchar) || '-' || greatest(nodes[1]::varchar, nodes[3]::varchar) as ac, least(nodes[2]::varchar, nodes[3]::varchar) || '-' || greatest(nodes[2]::varchar, nodes[3]::varchar) as bc from t)
    select element, 0 as child, a as p, ab as q, ac as r from m union all select element, 1, b, ab, bc from m union all select element, 2, c, ac, bc from m union all select element, 3, ab, ac, bc from m""")
def uniform_refine(spark, d):
    """Every triangle's four children, by the names of their corners."""
    rows = quantities.refined_triangles(_triangles(spark, d))
    return rows.select("element", "child", *[F.col("nodes")[k].alias(c) for k, c in enumerate("pqr")])


@query(f"""with recursive {_SERIES}, t as (select *, 1::double / (n - 1) as h, case when i = 0 or i = n - 1 then 1 else 2 end as sides from g),
    f(user_id, n, i, h, diagonal, rhs) as (
        select user_id, n, i, h, h / 3, v from t where i = 0
        union all
        select t.user_id, t.n, t.i, t.h, t.sides * t.h / 3 - t.h / 6 * t.h / 6 / f.diagonal, t.v - t.h / 6 / f.diagonal * f.rhs from f join t on t.user_id = f.user_id and t.i = f.i + 1),
    b(user_id, i, x) as (
        select user_id, i, rhs / diagonal from f where i = n - 1
        union all
        select f.user_id, f.i, (f.rhs - f.h / 6 * b.x) / f.diagonal from b join f on f.user_id = b.user_id and f.i = b.i - 1)
    select user_id, i, round(x, 4) as x from b""")
def mass_solve(spark, d):
    """Conjugate gradients with each series' mass matrix; the SQL eliminates."""

    def one(pdf):
        pdf = pdf.sort_values("i")
        v = pdf["v"].to_numpy()
        x = np.linspace(0, 1, len(v))
        diagonal = blocks.mass(np.ones_like(v), x, 0)
        return pdf[["user_id", "i"]].assign(x=quantities.conjugate_gradient(lambda u: blocks.mass(u, x, 0), v, diagonal, 1e-15))

    return _events(spark, d).groupBy("user_id").applyInPandas(one, "user_id long, i long, x double").select("user_id", "i", F.round("x", 4).alias("x"))


# --- scans, sorts, coding ---------------------------------------------------------------------------------


@query("""select o_custkey, o_orderkey, round(sum(o_totalprice) over w, 2) as inclusive, round(coalesce(sum(o_totalprice) over (w rows between unbounded preceding and 1 preceding), 0), 2) as exclusive
    from orders window w as (partition by o_custkey order by o_orderkey)""")
def scans(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("inclusive"), F.round(F.coalesce(before, F.lit(0.0)), 2).alias("exclusive"))


@query("""with e as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as k from orders)
    select o_custkey, k::int as pos, round(sum(o_totalprice) over (partition by o_custkey order by k), 2) as total from e union all select distinct o_custkey, 0, 0.0 from orders""")
def scan_extended(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", F.row_number().over(w).alias("pos"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"))
    return rows.unionByName(rows.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("pos"), F.lit(0.0).alias("total")))


@query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as int) as pos from orders")
def sort_by_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("pos"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select o_custkey as block_id, true as same from orders group by o_custkey")
def codec_roundtrip(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("block_id")).agg(F.array_sort(F.collect_list((F.col("o_totalprice") / 100).cast("long"))).alias("q"))
    back = coding.decode_blocks(coding.encode_blocks(rows)).withColumnRenamed("q", "b")
    return rows.join(back, "block_id").select("block_id", (F.col("q") == F.col("b")).alias("same"))


@query("select o_custkey as block_id, true as ok from orders group by o_custkey")
def header_check(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("block_id")).agg(F.array_sort(F.collect_list((F.col("o_totalprice") / 100).cast("long"))).alias("q"))
    coded = coding.with_header(coding.encode_blocks(rows), shape=[1], dtype="double", norm="infinity", tolerance=1.0, levels=1)
    return coding.checked(coded).select("block_id", (F.col("header.dtype") == "double").alias("ok"))


@query(f"with {_SERIES} select user_id as block_id, true as within from g group by all")
def compress_bound(spark, d):
    """Orthogonal compression of every series: decoded values are within the tolerance."""
    data = _long_series(spark, d)
    back = fields.decompress(fields.compress(data, None, _TAU)).withColumnRenamed("data", "b")
    return data.join(back, "block_id").select("block_id", (F.array_max(F.zip_with("data", "b", lambda x, y: F.abs(x - y))) <= _TAU).alias("within"))


@query()
def compression_ratio(spark, d):
    c = fields.compress(_long_series(spark, d), None, _TAU)
    return c.groupBy("codec").agg(F.count("*").alias("blocks"), (F.sum("raw_bytes") / F.sum(F.octet_length("payload"))).alias("ratio"))


@query("""select width_bucket_day as start, n, round(linf, 6) as linf from (select date_trunc('day', ts) as width_bucket_day, count(*) as n, max(abs(value)) as linf from events group by 1)""")
def window_norms(spark, d):
    """The batch form of the event-time windows."""
    rows = table(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("linf"))
    return rows.select("start", "n", r6("linf", "linf"))


from gridloom.plans import extended  # noqa: E402, F401  registers further queries
