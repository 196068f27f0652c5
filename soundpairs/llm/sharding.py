"""Weighted hash tree: regions hold racks, racks hold shards.

A row goes down from the root. At each node every child draws ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's name; the least draw wins. A draw depends on
nothing but key, name and weight, so a changed weight moves rows only into or out of that
child's subtree (Python is not involved; all of it is column expressions).

Growth by one shard hangs a region of one rack and one shard under the root. All other draws
stay as they are, so the new shard takes rows and no other row moves.

Null keys are drawn as the text ``null``. Slots order a shard by (hash of the key, key, crc, size);
repeated rows get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAW = "key"
#: Rows that share a window when slots are numbered.
ROWS_PER_BUCKET = 2000
_DIGITS = 13
_SPACE = float(16**_DIGITS)


@dataclass(frozen=True)
class Node:
    """A region, rack or (without children) shard. A node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves] if self.children else [self]


def tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Node:
    """Shards are named by number, from 0, in order."""
    def rack(r: int, k: int) -> Node:
        first = (r * racks + k) * shards
        return Node(f"r{r}k{k}", tuple(Node(str(first + s)) for s in range(shards)))

    return Node("root", tuple(Node(f"r{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own."""
    number, region = len(root.leaves), len(root.children)
    shard = Node(str(number), (), weight)
    return Node(root.name, (*root.children, Node(f"r{region}", (Node(f"r{region}k0", (shard,)),))))


def hash_number(text: Column) -> Column:
    """52 bits of the text's digest."""
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def _draw(key: Column, child: Node) -> Column:
    u = (hash_number(F.concat(key, F.lit("/" + child.name))).cast("double") + 0.5) / _SPACE
    return -F.log(u) / F.lit(child.weight)


def _winner(key: Column, node: Node) -> Column:
    if len(node.children) == 1:
        return F.lit(node.children[0].name)
    draws = [F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("i"), F.lit(c.name).alias("name"))
             for i, c in enumerate(node.children)]
    return F.array_min(F.array(*draws))["name"]


def place(df: DataFrame, key: Column, root: Node, out: str) -> DataFrame:
    """Adds the shard number ``out`` of every row."""
    df = df.withColumn("_key", F.coalesce(key.cast("string"), F.lit("null"))).withColumn("_at", F.lit(root.name))
    level = [root]
    while any(n.children for n in level):
        at = F.col("_at")
        step = None
        for node in level:
            if node.children:
                here = _winner(F.col("_key"), node)
                step = F.when(at == node.name, here) if step is None else step.when(at == node.name, here)
        df = df.withColumn("_at", step.otherwise(at))
        level = [c for n in level for c in n.children]
    return df.withColumn(out, F.col("_at").cast("int")).drop("_at", "_key")


def numbered(df: DataFrame, group: str, order: Column, ties: list[Column], rows: int) -> DataFrame:
    """``slot``: gapless from 0 within ``group``, by (order, ties); ``order`` is a 52-bit number.

    Rows are counted by (group, range of the order), ranges get their offsets, and only rows of one
    range are numbered together, so that no task holds a whole group.
    """
    ranges = max(1, math.ceil(rows / max(1, ROWS_PER_BUCKET)))
    width = max(1, math.ceil(_SPACE / ranges))
    df = df.withColumn("_order", order).withColumn("_range", F.floor(F.col("_order") / F.lit(width)).cast("long"))
    from pyspark.sql import Window

    offset = (
        df.groupBy(group, "_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(
            Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .select(group, "_range", "_before")
    )
    within = Window.partitionBy(group, "_range").orderBy("_order", *ties)
    return (
        df.join(offset, [group, "_range"])
        .withColumn("slot", (F.col("_before") + F.row_number().over(within) - 1).cast("long"))
        .drop("_order", "_range", "_before")
    )


def shard_documents(docs: DataFrame, root: Node | None = None) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard after growth by one.

    Texts are read where they lie; only ids, sizes and checksums are shuffled.
    """
    root = root or tree()
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = place(place(narrow, F.col("doc_id"), root, "shard"), F.col("doc_id"), grown(root), "grown_shard")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/slot"))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    per_shard = math.ceil(docs.count() / len(root.leaves))
    return numbered(placed, "shard", hash_number(key), ties, per_shard).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(child: Node) -> str:
    bits = f"cast('0x' || substr(md5(k || '/{child.name}'), 1, {_DIGITS}) as bigint)"
    return f"-ln((cast({bits} as double) + 0.5) / {_SPACE!r}) / {child.weight!r}"


def _place_sql(root: Node, out: str, source: str) -> str:
    """CTEs that add ``out`` to ``source`` (with the key k), one level each."""
    steps, level, n = [], [root], 0
    at = f"'{root.name}'"
    while any(x.children for x in level):
        cases = []
        for node in level:
            if len(node.children) == 1:
                cases.append(f"when {at} = '{node.name}' then '{node.children[0].name}'")
            elif node.children:
                draws = ", ".join(f"{{'draw': {_draw_sql(c)}, 'i': {i}, 'name': '{c.name}'}}" for i, c in enumerate(node.children))
                cases.append(f"when {at} = '{node.name}' then list_min([{draws}]).name")
        steps.append(f"{out}{n} as (select *, case {' '.join(cases)} else {at} end as {out}_{n} from {source})")
        source, at = f"{out}{n}", f"{out}_{n}"
        level, n = [c for x in level for c in x.children], n + 1
    steps.append(f"{out}_done as (select *, cast({at} as integer) as {out} from {source})")
    return ",\n".join(steps)


def shard_sql(root: Node | None = None) -> str:
    """The same in SQL, over ``documents``; checksums byte by byte."""
    root = root or tree()
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    crc = f"""xor(list_reduce(list_prepend(cast(4294967295 as bigint),
      list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast('0x' || x as bigint))),
      lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), cast(4294967295 as bigint))"""
    return f"""
with rows_ as (
  select doc_id, coalesce(text, '') as t, coalesce(cast(doc_id as varchar), 'null') as k from documents),
narrow as (
  select doc_id, k, cast(octet_length(encode(t)) + 8 as bigint) as size, cast({crc} as bigint) as text_crc32 from rows_),
{_place_sql(root, 'shard', 'narrow')},
{_place_sql(grown(root), 'grown_shard', 'shard_done')}
select doc_id, size, text_crc32, '{LAW}' as law, shard, row_number() over (partition by shard
    order by cast('0x' || substr(md5(k || '/slot'), 1, {_DIGITS}) as bigint), doc_id nulls first, text_crc32, size) - 1 as slot,
  grown_shard
from grown_shard_done"""
