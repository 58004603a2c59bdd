"""Further queries: domains and orders of nodes, partial levels, base -2 planes, nested regions, plasma quantities, simplices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators import bitplanes, coding, domains, fields, quantities, series
from gridloom.plans.catalogue import _LEVELS, _SERIES, _TRI, _events, _nodes, _points, _triangles, query, r6, table
from gridloom.plans.grid import cubic_blocks, split_longest

# --- domains and orders ----------------------------------------------------------------------------

_WIDE = 64


def _field(spark, d) -> DataFrame:
    """Vectors as rows of a grid: r, c, v."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))


_FIELD = "f as (select vec_id as r, cast(unnest(range(0, 64)) as bigint) as c, unnest(embedding)::double as v from embeddings)"


@query(f"""with recursive {_FIELD}, s as (select max(r) + 1 as n from f),
    h(size) as (select greatest(n, 64) from s union all select (size + 1) // 2 from h, s where size > 1 and size * least(n, 64) > 2048),
    z as (select min(size) as size from h)
    select case when n >= 64 then r // size else c // size end as block_id, count(*) as nodes, round(max(abs(v)), 6) as linf from f, s, z group by 1""")
def domain_largest_side(spark, d):
    """The longest side is halved until a block fits; each block's nodes and norm."""
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    dim, size = split_longest((n, _WIDE), 2048)
    rows = domains.in_blocks(_field(spark, d), {("r", "c")[dim]: size}, [1])
    return rows.groupBy("block_id").agg(F.count("*").alias("nodes"), r6(F.max(F.abs("v")), "linf"))


@query(f"""with {_FIELD} select (r // 20) * 4 + c // 20 as block_id, count(*) as nodes, round(sum(v), 5) as total from f group by 1""")
def domain_cubes(spark, d):
    """Square blocks, halved until one fits, numbered in row-major order."""
    size = cubic_blocks((10**9, _WIDE), 40, 400)[0]
    rows = domains.in_blocks(_field(spark, d), {"r": size, "c": size}, [1, -(-_WIDE // size)])
    return rows.groupBy("block_id").agg(F.count("*").alias("nodes"), F.round(F.sum("v"), 5).alias("total"))


@query(f"""with {_FIELD}, b as (select *, (c >= 5)::int + (c >= 25)::int + (c >= 57)::int as block_id from f)
    select block_id, cast(c - [0, 5, 25, 57][block_id + 1] as int) as "offset", count(*) as nodes, round(max(v), 6) as top from b group by all""")
def domain_variable(spark, d):
    """Blocks of given sizes along one side."""
    rows = domains.in_variable_blocks(_field(spark, d), "c", [5, 20, 32])
    return rows.groupBy("block_id", "offset").agg(F.count("*").alias("nodes"), r6(F.max("v"), "top"))


@query(f"with {_FIELD} select r, cast(c as int) as c, round(case when r >= 10 and r < 90 and c >= 8 and c < 24 then -2 * v else v end, 6) as v from f")
def copy_subdomain(spark, d):
    """A box is taken out, changed, and put back."""
    field, bounds = _field(spark, d), {"r": (10, 90), "c": (8, 24)}
    inner = domains.take_box(field, bounds).withColumn("v", -2 * F.col("v"))
    return domains.put_box(field, inner, bounds).select("r", "c", r6("v", "v"))


@query("select o_orderkey, (o_orderkey % 7) * 55 + (o_custkey % 5) * 11 + o_custkey % 11 as place, o_orderkey % 7 as i, o_custkey % 5 as j, o_custkey % 11 as k from orders")
def flat_index(spark, d):
    """Places of multi-indices, and these back from the places."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select("o_orderkey", domains.flat_index([o % 7, c % 5, c % 11], [7, 5, 11]).alias("place"))
    i, j, k = domains.multi_index(F.col("place"), [7, 5, 11])
    return rows.select("o_orderkey", "place", i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"))


@query("select n_nationkey, cast(a as int) as a, cast(b as int) as b, cast(n_nationkey * 100 + a * 10 + b as bigint) as place from nation, (select unnest(range(0, 3)) as a), (select unnest([1, 4, 6, 9]) as b)")
def cartesian_product(spark, d):
    rows = domains.cartesian(table(spark, d, "nation").select("n_nationkey"), {"a": F.sequence(F.lit(0), F.lit(2)), "b": F.array(*map(F.lit, (1, 4, 6, 9)))})
    return rows.withColumn("place", (F.col("n_nationkey") * 100 + F.col("a") * 10 + F.col("b")).cast("long"))


@query("""with v as (select o_custkey, list(o_totalprice order by o_orderkey) as a, list(o_orderkey order by o_orderkey) as k from orders group by 1),
    z as (select o_custkey, unnest(range(0, len(a[2:5]))) as pos, unnest(a[2:5]) as price, unnest(k[2:5]) as orderkey from v)
    select o_custkey, cast(pos as int) as pos, price, orderkey from z""")
def zipped_slices(spark, d):
    """Two arrays side by side, numbered, from the second entry to the fifth."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("r"))
    cut = lambda c: F.slice(F.transform("r", lambda x: x[c]), 2, 4)
    return rows.select("o_custkey", F.posexplode(F.arrays_zip(cut("o_totalprice").alias("price"), cut("o_orderkey").alias("orderkey"))).alias("pos", "z")).select("o_custkey", "pos", "z.price", "z.orderkey")


@query("""with v as (select o_custkey, list(cast(floor(o_totalprice / 100000) as bigint) order by o_orderkey) as a, list(o_orderkey order by o_totalprice desc, o_orderkey) as by_price from orders group by 1)
    select o_custkey, a[len(a)] as first_of_reversed, cast(coalesce(list_position(list_transform(a, lambda x: x <> 0), true), 0) - 1 as int) as first_nonzero, by_price[1] as first_by_price, cast(len(a) * (len(a) - 1) // 2 as bigint) as filled from v""")
def sequence_helpers(spark, d):
    """An array reversed, its first entry that isn't zero (-1: none), another array in its order, and a filled sequence's sum."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("q")))).alias("r"), F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("s"))
    a = F.transform("r", lambda x: x["q"])
    nonzero = F.array_position(F.transform(a, lambda x: x != 0), True) - 1
    filled = F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select("o_custkey", F.get(F.reverse(a), F.lit(0)).alias("first_of_reversed"), nonzero.cast("int").alias("first_nonzero"), F.get("s", F.lit(0))["o_orderkey"].alias("first_by_price"), filled.alias("filled"))


_CUBE = f"{_FIELD}, q as (select r, v, c // 16 as i, (c // 4) % 4 as j, c % 4 as k from f), b as (select *, (i >= 2)::int * 4 + (j >= 2)::int * 2 + (k >= 2)::int as part from q)"


def _cubes(spark, d) -> DataFrame:
    i, j, k = (x.cast("long") for x in domains.multi_index(F.col("c"), [4, 4, 4]))
    rows = _field(spark, d).select("r", "v", i.alias("i"), j.alias("j"), k.alias("k"))
    return rows.withColumn("part", domains.sub_block([F.col("i"), F.col("j"), F.col("k")], 2)).filter("part > 0")


def _gathered(rows: DataFrame, *order) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("r").orderBy(*order)) - 1
    return rows.select("r", "i", "j", "k", pos.alias("pos"))


@query(f"with {_CUBE} select r, i, j, k, cast(row_number() over (partition by r order by part, i, j, k) - 1 as int) as pos from b where part > 0")
def interleave_direct(spark, d):
    """New coefficients of a 4 x 4 x 4 level, part after part, row-major."""
    return _gathered(_cubes(spark, d), "part", "i", "j", "k")


@query(f"with {_CUBE} select r, i, j, k, cast(row_number() over (partition by r order by part, ((i % 2) // 1) * 4 + ((j % 2) // 1) * 2 + k % 2) - 1 as int) as pos from b where part > 0")
def interleave_blocked(spark, d):
    """Part after part, each gathered block by block (blocks of one node a side here)."""
    own = [F.col(c) % 2 for c in ("i", "j", "k")]
    return _gathered(_cubes(spark, d), "part", domains.block_key(own, 1, 2))


@query(f"with {_CUBE} select r, i, j, k, cast(row_number() over (partition by r order by (i % 2) * 4 + (j % 2) * 2 + k % 2, part) - 1 as int) as pos from b where part > 0")
def interleave_curve(spark, d):
    """Along the curve through the parts' places, one node of every part at each."""
    return _gathered(_cubes(spark, d), domains.curve_key([F.col(c) % 2 for c in ("i", "j", "k")], 1), "part")


# --- levels ------------------------------------------------------------------------------------------


@query(f"""with {_SERIES}, t as (select *, case when i = 0 or i = n - 1 then 0 else length(bin(n - 2)) - cast(round(log2(i & -i)) as bigint) end as lvl, i & -i as s from g),
    x as (select user_id, n, i, v, lvl, case when lvl > 0 then i - s end as il, case when lvl > 0 then least(i + s, n - 1) end as ir from t)
    select x.user_id, x.i, cast(x.lvl as int) as lvl, round(x.v - case when x.lvl > 0 then a.v + (x.i - il) / (ir - il)::double * (b.v - a.v) else 0 end, 6) as coef
    from x left join g a on a.user_id = x.user_id and a.i = il left join g b on b.user_id = x.user_id and b.i = ir""")
def halving_coefficients(spark, d):
    """Hierarchical coefficients of whole series on the halving hierarchy: levels and neighbours from a node's lowest bit."""
    rows = series.to_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return series.halving(rows, "user_id").select("user_id", "i", "lvl", r6("coef", "coef"))


@query(f"""with {_SERIES}, w as (select g.*, ((i * 4 + n - 2) // (n - 1)) as j from g where n > 4), x as (select user_id, n, i, v, case when j = 0 then 0 else ((j - 1) * (n - 1)) // 4 end as il, (j * (n - 1)) // 4 as ir from w)
    select x.user_id, x.i, round(case when x.i = ir then b.v else a.v + (x.i - il) / (ir - il)::double * (b.v - a.v) end, 6) as v from x join g a on a.user_id = x.user_id and a.i = il join g b on b.user_id = x.user_id and b.i = ir""")
def interpolate_to_level(spark, d):
    """Series rebuilt from their level 2 nodes alone: finer coefficients are zero."""
    rows = series.to_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").filter("n > 4")
    return series.from_level(rows, "user_id", 2).select("user_id", "i", r6("v", "v"))


# --- base -2 planes, tolerances ------------------------------------------------------------------------

_NB = "q as (select event_type, event_id, cast(floor(value * 8) as bigint) - 400 as q from events), n as (select *, xor(q + 11184810, 11184810) as nb from q)"


def _signed(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_type", "event_id", (F.floor(F.col("value") * 8) - 400).cast("long").alias("q"))


@query(f"""with {_NB} select event_type, event_id // 32 as block, cast(p as int) as bitplane, cast(sum(((nb >> (23 - p)) & 1) << (event_id % 32)) as bigint) as word
    from n, (select unnest(range(0, 24)) as p) group by all""")
def negabinary_words(spark, d):
    return bitplanes.negabinary_words(_signed(spark, d), ["event_type"], F.floor(F.col("event_id") / 32), (F.col("event_id") % 32).cast("int"), 24)


@query(f"""with {_NB}, k as (select event_type, kept, abs(xor(nb & ((1 << (24 - kept)) - 1), 11184810) - 11184810)::double as e from n, (select unnest(range(0, 25)) as kept))
    select event_type, cast(kept as int) as kept, sum(e * e) as sq_err, max(e) as max_err from k group by all""")
def negabinary_errors(spark, d):
    return bitplanes.negabinary_errors(_signed(spark, d), ["event_type"], 24)


@query("select l_returnflag, round(1e-3 * (max(l_extendedprice) - min(l_extendedprice)), 6) as tolerance from lineitem group by all")
def range_tolerance(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(1e-3 * (F.max("l_extendedprice") - F.min("l_extendedprice")), "tolerance"))


@query(f"""with {_SERIES}, w as (select user_id, sqrt(sum(power(case when i = 0 or i = n - 1 then 0.5 else 1 end / (n - 1), 2))) as size from g group by 1)
    select user_id, i, round(0.01 / size, 9) as tolerance from g join w using (user_id)""")
def node_tolerance(spark, d):
    """Each series' tolerance for its mean: the bound divided by the functional's norm, joined back to the nodes."""
    rows = _events(spark, d)
    share = quantities.edge_factor(F.col("i"), F.col("n") - 1) / (F.col("n") - 1)
    size = rows.groupBy("user_id").agg(F.sqrt(F.sum(share * share)).alias("size"))
    return rows.join(size, "user_id").select("user_id", "i", F.round(0.01 / F.col("size"), 9).alias("tolerance"))


# --- regions -----------------------------------------------------------------------------------------


@query(f"""with {_LEVELS}, w as (select user_id, i, case when lvl > 0 then v - interp else 0 end as d from c),
    a as (select user_id, i // 16 as b, round(sum(abs(d)) / count(*), 9) as m from w group by all),
    ka as (select user_id, b from (select *, row_number() over (partition by user_id order by m desc, b) as k, count(*) over (partition by user_id) as n from a) where k <= ceil(0.5 * n)),
    inner_blocks as (select w.user_id, i // 4 as b, round(sum(abs(d)) / count(*), 9) as m from w join ka on ka.user_id = w.user_id and ka.b = i // 16 group by all)
    select user_id, b as block from (select *, row_number() over (partition by user_id order by m desc, b) as k, count(*) over (partition by user_id) as n from inner_blocks) where k <= ceil(0.25 * n)""")
def nested_regions(spark, d):
    """The most active half of the blocks of 16 nodes, cut into blocks of four, and the most active quarter of these."""
    rows = series.hierarchical(_nodes(spark, d)).select("user_id", "i", "lvl", "coef")
    return quantities.nested_regions(rows, ["user_id"], 16, [0.5, 0.25], 4).select("user_id", "block")


@query(f"""with {_LEVELS}, w as (select *, v - interp as coef, case when lvl > 0 then v - interp else 0 end as d, max(lvl) over (partition by user_id) as top from c),
    a as (select user_id, i // 16 as b, round(sum(abs(d)) / count(*), 9) as m from w group by all),
    ka as (select user_id, b from (select *, row_number() over (partition by user_id order by m desc, b) as k, count(*) over (partition by user_id) as n from a) where k <= ceil(0.5 * n)),
    ib as (select w.user_id, i // 4 as b, round(sum(abs(d)) / count(*), 9) as m from w join ka on ka.user_id = w.user_id and ka.b = i // 16 group by all),
    kb as (select user_id, b from (select *, row_number() over (partition by user_id order by m desc, b) as k, count(*) over (partition by user_id) as n from ib) where k <= ceil(0.25 * n)),
    g2 as (select w.*, (select min(greatest(b * 4 - i, i - b * 4 - 3, 0)) from kb where kb.user_id = w.user_id) as gap from w)
    select user_id as block_id, cast(i as int) as i, cast(case when gap <= 2 * power(2, top - lvl) then sign(coef) * floor(abs(coef / 0.25) + 0.5) else 23 * sign(coef) * floor(abs(coef / (0.25 * 23)) + 0.5) end as bigint) as q from g2""")
def compress_roi(spark, d):
    """Regions found, zones by level, quantized, coded and decoded again."""
    rows = series.hierarchical(_nodes(spark, d)).select("user_id", "n", "i", "lvl", "coef")
    coded = fields.compress_regions(rows, "user_id", 16, [0.5, 0.25], 4, 2, 0.25, 23)
    return coding.decode_blocks(coded).select("block_id", F.posexplode("q").alias("i", "q"))


@query("select o_custkey as block_id, 1 as dims, count(*) as nodes, 'double' as dtype, 0.5::double as tolerance from orders group by o_custkey")
def header_inferred(spark, d):
    """Sizes and settings of coded blocks, without their payloads."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("block_id")).agg(F.collect_list((F.col("o_totalprice") / 100).cast("long")).alias("q"))
    coded = coding.encode_blocks(rows, "zstd").withColumn("nodes", (F.col("raw_bytes") / 8).cast("int"))
    coded = coding.with_header(coded, shape=F.array("nodes"), dtype="double", norm="infinity", tolerance=0.5, levels=1)
    return coding.inferred(coded).select("block_id", "dims", "nodes", "dtype", "tolerance")


@query(f"""with {_LEVELS} select user_id, i from (select user_id, i, row_number() over (partition by user_id order by round(v - interp, 9) desc, i) as k, count(*) over (partition by user_id) as n from c) where k <= ceil(0.1 * n)""")
def top_nodes(spark, d):
    """Nodes with the largest coefficients, signs and all."""
    rows = series.hierarchical(_nodes(spark, d)).select("user_id", "i", F.round("coef", 9).alias("activity"))
    return quantities.top_fraction(rows.withColumnRenamed("i", "block"), ["user_id"], 0.1).select("user_id", F.col("block").alias("i"))


# --- plasma ------------------------------------------------------------------------------------------

_PLASMA = """p as (select l_suppkey, l_quantity as f, l_tax + 0.01 as cell, cast(round(l_discount * 100) as bigint) as imu, l_linenumber - 4 as vp, 1 + l_suppkey % 5 * 0.3 as vth from lineitem),
    w as (select *, (imu * 0.3) * (imu * 0.3) as mu, cell * case when imu in (0, 10) then 0.5 else 1 end * case when vp in (-3, 3) then 0.5 else 1 end as vol from p)"""


def _distribution(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("f"), (F.col("l_tax") + 0.01).alias("cell"), F.round(F.col("l_discount") * 100).cast("long").alias("imu"), (F.col("l_linenumber") - 4).alias("vp"), (1 + F.col("l_suppkey") % 5 * 0.3).alias("vth"))
    edges = quantities.edge_factor(F.col("imu"), 10) * quantities.edge_factor(F.col("vp"), 3, -3)
    return rows.withColumn("mu", F.col("imu") * 0.3 * (F.col("imu") * 0.3)).withColumn("vol", F.col("cell") * edges)


@query(f"""with {_PLASMA}, m as (select l_suppkey, sum(f * vol) as n, sum(f * vol * vp * vth) / sum(f * vol) as flow, sum(f * vol * 0.5 * mu * vth * vth) * 2 / sum(f * vol) / 3 as across from w group by 1),
    t as (select l_suppkey, 2 * sum(f * vol * 0.5 * power(vp - flow / vth, 2) * vth * vth * 2) / any_value(n) / 3 as along from w join m using (l_suppkey) group by 1)
    select l_suppkey, round(n, 4) as density, round(flow, 6) as flow, round(across, 6) as t_across, round(along, 6) as t_along, round((2 * across + along) / 3, 6) as t_mean from m join t using (l_suppkey) where n <> 0""")
def plasma_moments(spark, d):
    m = quantities.plasma_moments(_distribution(spark, d), ["l_suppkey"], F.col("f"), F.col("vol"), F.col("mu"), F.col("vp"), F.col("vth"), 2.0, 3.0)
    return m.select("l_suppkey", F.round("density", 4).alias("density"), *[r6(c, c) for c in ("flow", "t_across", "t_along", "t_mean")])


@query(f"""with {_PLASMA}, s as (select l_suppkey, 2 * sum(f * vol * vth * vth * vth * vp * vp * vp) as v3, 2 * sum(f * vol * vth * vth * vth * vp * (imu * 0.3) * (imu * 0.3)) as vw2 from w group by 1)
    select l_suppkey, round(v3, 9) as v3, round(vw2, 9) as vw2 from s""")
def third_moments(spark, d):
    m = quantities.third_moments(_distribution(spark, d), ["l_suppkey"], F.col("f"), F.col("vol"), 2 * F.col("vth") * F.col("vth") * F.col("vth"), F.col("vp"), F.col("imu") * 0.3)
    return m.select("l_suppkey", F.round("v3", 9).alias("v3"), F.round("vw2", 9).alias("vw2"))


@query(f"with {_PLASMA} select distinct imu, cast(vp as int) as vp, round(mu, 6) as mu, case when imu in (0, 10) then 0.5::double else 1.0::double end as mu_volume, case when vp in (-3, 3) then 0.5::double else 1.0::double end as vp_volume from w")
def moment_parameters(spark, d):
    """The velocity grid: its places, squares and weights, one row for each."""
    return _distribution(spark, d).select("imu", "vp", r6("mu", "mu"), quantities.edge_factor(F.col("imu"), 10).alias("mu_volume"), quantities.edge_factor(F.col("vp"), 3, -3).alias("vp_volume")).distinct()


_FIELDS = "k as (select c_custkey, 2 + c_custkey % 7 * 0.5 as b, (c_custkey % 3 - 1) * 0.1 as gr, (c_custkey % 5 - 2) * 0.2 as gz, c_custkey % 2 * 0.3 as cr, c_custkey % 4 * 0.05 as cz, c_acctbal / 1000 as er, c_nationkey * 0.1 as ez, c_custkey % 9 * 0.5 as mu, c_nationkey % 5 - 2.0 as vp from customer)"


@query(f"with {_FIELDS} select c_custkey, round(2 * vp * vp / (3 * b) * cr - (mu * gz - 3 * ez) / (3 * b), 9) as dr, round(2 * vp * vp / (3 * b) * cz + (mu * gr - 3 * er) / (3 * b), 9) as dz from k")
def drift_velocity(spark, d):
    """Drift from curvature, the field's gradient and the electric field."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cols = {"b": 2 + k % 7 * 0.5, "gr": (k % 3 - 1) * 0.1, "gz": (k % 5 - 2) * 0.2, "cr": k % 2 * 0.3, "cz": k % 4 * 0.05, "er": F.col("c_acctbal") / 1000, "ez": n * 0.1, "mu": k % 9 * 0.5, "vp": n % 5 - 2.0}
    rows = table(spark, d, "customer").select("c_custkey", *[c.alias(a) for a, c in cols.items()])
    return quantities.drift(rows, 2.0, 3.0).select("c_custkey", F.round("dr", 9).alias("dr"), F.round("dz", 9).alias("dz"))


@query("""with k as (select o_orderkey, o_custkey % 100 / 10.0::double as r, o_orderkey % 70 / 10.0::double as z, o_totalprice / 100000 as psi from orders)
    select o_orderkey, (psi <= 0.99 and (z - 2) - (r - 4) * 0.5 > 0 and (z - 5) - (r - 6) * -0.25 < 0) or (psi > 0.99 and psi <= 1.99 and (z - 5) - (r - 6) * -0.25 < 0) or psi > 1.99 as inside from k""")
def region_test(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100 / 10).alias("r"), (F.col("o_orderkey") % 70 / 10).alias("z"), (F.col("o_totalprice") / 100000).alias("psi"))
    return rows.select("o_orderkey", quantities.core_region(F.col("r"), F.col("z"), F.col("psi"), (4.0, 2.0, 1.0, 0.5), (6.0, 5.0, 2.0, -0.25), 0.01).alias("inside"))


# --- simplices ---------------------------------------------------------------------------------------

_TETS = """t as (select l_orderkey, l_linenumber, [l_partkey % 7, l_partkey % 11, l_partkey % 13] as p, [l_suppkey % 5, l_suppkey % 17, l_suppkey % 3] as q, [l_orderkey % 19, l_orderkey % 4, l_orderkey % 9] as r, [l_linenumber, l_partkey % 6, l_suppkey % 8] as s from lineitem)"""


@query(f"""with {_TETS}, e as (select *, list_transform(list_zip(q, p), lambda z: z[1] - z[2]) as a, list_transform(list_zip(r, p), lambda z: z[1] - z[2]) as b, list_transform(list_zip(s, p), lambda z: z[1] - z[2]) as c from t)
    select l_orderkey, l_linenumber, round(sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]), 6) as edge, round(abs(a[1] * (b[2] * c[3] - b[3] * c[2]) - a[2] * (b[1] * c[3] - b[3] * c[1]) + a[3] * (b[1] * c[2] - b[2] * c[1])) / 6, 6) as volume,
           cast(sign(a[1] * (b[2] * c[3] - b[3] * c[2]) - a[2] * (b[1] * c[3] - b[3] * c[1]) + a[3] * (b[1] * c[2] - b[2] * c[1])) as int) as orientation from e""")
def simplex_measures(spark, d):
    """Edge length, volume and orientation of a tetrahedron for each row."""
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    point = lambda *c: F.struct(*[x.cast("double").alias(n) for x, n in zip(c, "xyz", strict=True)])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", point(part % 7, part % 11, part % 13).alias("p"), point(supp % 5, supp % 17, supp % 3).alias("q"), point(order % 19, order % 4, order % 9).alias("r"), point(line, part % 6, supp % 8).alias("s"))
    p, q, r, s = (F.col(c) for c in "pqrs")
    return rows.select("l_orderkey", "l_linenumber", r6(quantities.edge_length(p, q), "edge"), r6(quantities.tetrahedron_volume(p, q, r, s), "volume"), F.signum(quantities.tetrahedron_volume(p, q, r, s, True)).cast("int").alias("orientation"))


_EDGES = f"{_TRI}, e as (select distinct unnest([nodes[1], nodes[1], nodes[2]]) as a, unnest([nodes[2], nodes[3], nodes[3]]) as b from t), v as (select node, x * 0.5 - y as v from p), m as (select a, b, (a * 31 + b * 17) % 101 * 0.25 as vm from e)"


def _mesh(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = quantities.edges_of(_triangles(spark, d))
    values = _points(spark).select("node", (F.col("x") * 0.5 - F.col("y")).alias("v"))
    return edges, values, edges.withColumn("vm", (F.col("a") * 31 + F.col("b") * 17) % 101 * 0.25)


@query(f"with {_EDGES} select m.a, m.b, round(vm - (x.v + y.v) / 2, 6) as detail from m join v x on x.node = m.a join v y on y.node = m.b")
def mesh_details(spark, d):
    """Hierarchical coefficients of the nodes that a refinement brings."""
    edges, values, middles = _mesh(spark, d)
    return quantities.midpoint_details(edges, values, middles).select("a", "b", r6("detail", "detail"))


@query(f"with {_EDGES}, h as (select unnest([a, b]) as node, vm / 2 as half from m) select node, round(any_value(v.v) + coalesce(sum(half), 0), 6) as v from v left join h using (node) group by node")
def mesh_restriction(spark, d):
    """What a refined mesh's entries are worth on the coarse one."""
    _, values, middles = _mesh(spark, d)
    return quantities.mesh_restriction(values, middles).select("node", r6("v", "v"))


@query(f"""with {_TRI}, c as (select element, nodes, list_sort([least(nodes[1], nodes[2]) * 1000 + greatest(nodes[1], nodes[2]), least(nodes[1], nodes[3]) * 1000 + greatest(nodes[1], nodes[3]), least(nodes[2], nodes[3]) * 1000 + greatest(nodes[2], nodes[3])]) as edges from t)
    select element, cast(unnest(edges) as bigint) as middle, cast(4 as int) as children from c""")
def mesh_children(spark, d):
    """From parents to what a refinement makes of them: the middles of an element's edges, and how many children it has."""
    edge = lambda i, j: (F.least(F.col("nodes")[i], F.col("nodes")[j]) * 1000 + F.greatest(F.col("nodes")[i], F.col("nodes")[j])).cast("long")
    return _triangles(spark, d).select("element", F.explode(F.array(edge(0, 1), edge(0, 2), edge(1, 2))).alias("middle"), F.lit(4).alias("children"))
