"""Merkle manifest of a dataset: a tree per language, a tree over their roots, a proof per document.

Every node carries the interval [lo, hi) of leaf ranks that it covers. Ranks come
from one range partitioning, so no language is sorted in one task. The tree is
built in strips of four levels: sixteen neighbours of a level are gathered under
their bucket (rank without its low bits) and hashed upwards. Going down again,
each row is joined to its bucket's nodes on equality; its ancestors there are the
nodes whose interval holds its rank, and at each of them the sibling is what is
left of the ancestor's interval without the row's own node. What a strip's root
has gathered from the strips above comes along with it, so a leaf is joined once.

Defined cases: a null in any column enters its leaf as "-"; null languages are a
tree of their own, the first one; null ids stand first in their tree and are never
tampered with. Rows of one id stand in the order of their leaves; equal rows are
leaves each. One leaf is its own subroot, one subroot the root; a proof without
siblings is the hash of nothing. An empty table gives an empty result. Columns
beside the five are left out, whatever their names. Texts are hashed where they
are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import shuffle_partitions, staged

#: Levels of a strip; a bucket holds 2 ** BITS nodes of its lowest level.
BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a document: its five values, each with its length in bytes."""
    values = [F.col(c).cast("string") if c != "n_chars" or n_chars is None else n_chars.cast("string") for c in FIELDS]
    return _hashed(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, their rank within grp by order, and n, the rows of their grp. Ranges are sorted apart and offset by the counts before them."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows may stand in any order
    keys = ["grp", *order, "__tie"]
    dealt = tied.repartitionByRange(max(1, shuffle_partitions(rows.sparkSession)), *keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", 33))
    counts = dealt.groupBy("grp", "__part").agg(F.count("*").alias("c"), F.min("__at").alias("__first"))  # a row per range and group
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("c").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("grp", "__part", "__first", before.alias("__before"), F.sum("c").over(w).alias("n"))
    return dealt.join(places, ["grp", "__part"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def _nodes_at(level: int) -> Column:
    """How many nodes a group of n leaves has at a level."""
    return F.shiftright(F.col("n") + ((1 << level) - 1), level)


def _paired(level: Column) -> Column:
    """The level above a bucket's neighbours (pos, h); a last one alone is hashed alone."""
    digest = lambda i: _hex(F.get(level, i)["h"])
    node = lambda i: F.struct((F.shiftright(level[0]["pos"], 1) + i).alias("pos"), _hashed(F.concat(digest(2 * i), F.coalesce(digest(2 * i + 1), F.lit("")))).alias("h"))
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) + 1, 1) - 1), node)


def _strip(kids: DataFrame, base: int) -> DataFrame:
    """grp, pos, n, h of one level -> grp, blk, n, top (the highest node's digest), nodes (level, lo, hi, h of the bucket's nodes, in this order)."""
    rows = kids.groupBy("grp", F.shiftright("pos", BITS).alias("blk")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("l0"))
    for j in range(BITS):
        above = F.when(_nodes_at(base + j) > 1, _paired(F.col(f"l{j}"))).otherwise(F.array().cast("array<struct<pos:bigint,h:binary>>"))
        rows = rows.withColumn(f"l{j + 1}", above)
    node = lambda level: lambda x: F.struct(F.lit(level).alias("level"), F.shiftleft(x["pos"], level).alias("lo"), F.least(F.shiftleft(x["pos"] + 1, level), F.col("n")).alias("hi"), x["h"].alias("h"))
    nodes = F.flatten(F.array(*(F.transform(f"l{j}", node(base + j)) for j in range(BITS + 1))))
    root = F.coalesce(*(F.get(f"l{j}", F.lit(0))["h"] for j in range(BITS, -1, -1)))
    return rows.select("grp", "blk", "n", root.alias("top"), nodes.alias("nodes"))


def built(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The strips from the leaves (grp, pos, n, h) upwards, and grp, root."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    strips, roots, kids, base = [], None, leaves, 0
    while base == 0 or most > 1 << base:
        strip = staged(_strip(kids, base), f"strip-{base}")
        strips.append(strip)
        done = strip.where(_nodes_at(base + BITS) <= 1).select("grp", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        kids = strip.where(_nodes_at(base + BITS) > 1).select("grp", F.col("blk").alias("pos"), "n", F.col("top").alias("h"))
        base += BITS
    return strips, roots


def siblings(nodes: Column, base: int, rank: Column) -> Column:
    """Per ancestor of the rank in its bucket, lowest first: the side on which the sibling stands (0: there is none) and its digest."""
    holds = lambda x: (x["lo"] <= rank) & (rank < x["hi"])

    def beside(p: Column) -> Column:
        rest = F.get(F.filter(nodes, lambda c: (c["level"] == p["level"] - 1) & (c["lo"] >= p["lo"]) & (c["hi"] <= p["hi"]) & ~holds(c)), F.lit(0))
        return F.struct(F.when(rest.isNull(), 0).when(rest["lo"] > rank, 1).otherwise(-1).alias("side"), rest["h"].alias("h"))

    return F.transform(F.filter(nodes, lambda p: (p["level"] > base) & holds(p)), beside)


def attached(leaves: DataFrame, strips: list[DataFrame], groups: DataFrame) -> DataFrame:
    """leaves with path, their siblings up to the end of groups' own path, and what else groups (grp, path, ...) has."""
    more = [c for c in groups.columns if c not in ("grp", "path")]
    above = None
    for k in range(len(strips) - 1, -1, -1):
        base, strip = k * BITS, strips[k]
        here = strip.where(_nodes_at(base + BITS) <= 1).join(groups, "grp").select("grp", "blk", "nodes", "path", *more)
        if above is not None:
            up = above.select("grp", F.col("blk").alias("up"), F.col("nodes").alias("__over"), "path", *more)
            low = strip.where(_nodes_at(base + BITS) > 1).withColumn("up", F.shiftright("blk", BITS)).join(up, ["grp", "up"])
            path = F.concat(siblings(F.col("__over"), base + BITS, F.shiftleft("blk", base + BITS)), F.col("path"))
            here = here.unionByName(low.select("grp", "blk", "nodes", path.alias("path"), *more))
        above = here
    held = leaves.withColumn("blk", F.shiftright("pos", BITS)).join(above, ["grp", "blk"])
    return held.withColumn("path", F.concat(siblings(F.col("nodes"), 0, F.col("pos")), F.col("path"))).drop("blk", "nodes")


def manifest(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    Documents whose id's CRC-32 is divisible by seven are folded from a leaf with
    n_chars raised by one, and so fail to verify (unless n_chars is null).
    """
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("lang")))  # sorts nulls first
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    rows = docs.select(*FIELDS).select(group.alias("grp"), "doc_id", leaf().alias("h"), F.when(hit, leaf(more)).alias("other"))
    leaves = ranked(rows, ["doc_id", "h"], "manifest-leaves")
    strips, subroots = built(leaves.select("grp", "pos", "n", "h"))
    tops = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("root").alias("h")), ["own"], "manifest-subroots")
    over, root = built(tops.select("grp", "pos", "n", "h"))
    start = root.withColumn("path", F.array().cast("array<struct<side:int,h:binary>>"))
    groups = attached(tops, over, start).select(F.col("own").alias("grp"), F.col("h").alias("subroot"), "root", "path")
    held = attached(leaves, strips, staged(groups, "manifest-groups"))
    beside = F.filter("path", lambda s: s["side"] != 0)
    fold = F.aggregate("path", _hex(F.coalesce("other", "h")), lambda at, s: F.sha2(F.concat(F.when(s["side"] < 0, _hex(s["h"])).otherwise(""), at, F.when(s["side"] > 0, _hex(s["h"])).otherwise("")), 256))
    proof = F.sha2(F.array_join(F.transform(beside, lambda s: _hex(s["h"])), ""), 256)
    out = held.select("doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"), F.size(beside).cast("long").alias("n_siblings"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a text in SQL: {table} is one row, {crc} an expression of a column s of bytes' numbers.
CRC_TABLE = "crc_table as (select list(list_reduce(list_concat([i::ubigint], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) order by i) as crcs from range(256) t(i))"
CRC = "xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(0, strlen({s})), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * i + 2, 1)) - 17)::ubigint)), lambda c, b: xor(c >> 8, crcs[((xor(c, b) & 255) + 1)::bigint])), 4294967295)"


def _sql() -> str:
    leaf_of = lambda n: "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::varchar", "source", "lang", f"({n})::varchar", "text")) + ")"
    return f"""with recursive {CRC_TABLE},
    base as (select doc_id, coalesce(':' || lang, '-') as grp, {leaf_of("n_chars")} as leaf, case when doc_id is not null and {CRC.format(s="coalesce(doc_id::varchar, '')")} % 7 = 0 then {leaf_of("n_chars + 1")} end as other from documents, crc_table),
    leaves as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from base),
    tree as (select grp, 0 as level, pos, leaf as h, count(*) over (partition by grp) as n from leaves
      union all select grp, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from tree where n > 1 group by grp, level, pos // 2),
    subroots as (select grp, h as subroot, row_number() over (order by grp) - 1 as gpos from tree where n = 1),
    upper as (select 0 as level, gpos as pos, subroot as h, count(*) over () as n from subroots
      union all select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from upper where n > 1 group by level, pos // 2),
    heights as (select grp, max(level) as height from tree group by grp),
    steps as (select l.grp, l.pos, t.level, l.pos >> t.level as idx, s.h as sib from leaves l join tree t on t.grp = l.grp and t.pos = l.pos >> t.level and t.n > 1 left join tree s on s.grp = l.grp and s.level = t.level and s.pos = xor(l.pos >> t.level, 1)
      union all select l.grp, l.pos, h.height + u.level, g.gpos >> u.level, s.h from leaves l join subroots g on g.grp = l.grp join heights h on h.grp = l.grp join upper u on u.pos = g.gpos >> u.level and u.n > 1 left join upper s on s.level = u.level and s.pos = xor(g.gpos >> u.level, 1)),
    paths as (select grp, pos, list(struct_pack(idx := idx, sib := coalesce(sib, '')) order by level) as path from steps group by grp, pos),
    joined as (select l.*, g.subroot, (select h from upper where n = 1) as root, coalesce(path, []) as path from leaves l join subroots g on g.grp = l.grp left join paths p on p.grp = l.grp and p.pos = l.pos),
    folds as (select grp, pos, coalesce(other, leaf) as h, 1 as k from joined
      union all select f.grp, f.pos, sha256(case when path[k].idx % 2 = 1 then path[k].sib || f.h else f.h || path[k].sib end), k + 1 from folds f join joined j on j.grp = f.grp and j.pos = f.pos where k <= len(path))
    select j.doc_id, j.leaf, j.subroot, j.root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda s: s.sib)), 'string_agg', '')) as proof_sha256, f.h as folded_root, f.h = j.root as verified, len(list_filter(path, lambda s: s.sib <> ''))::bigint as n_siblings
    from joined j join folds f on f.grp = j.grp and f.pos = j.pos and f.k = len(path) + 1"""


ORACLE_SQL = _sql()
