"""Merkle manifest of a table: a digest of every row, a tree of digests per group, and a proof for every row.

The digest of a row is that of its fields; the rows of a group are ordered, and every two consecutive digests become
one until one remains. The groups' roots, in order of the groups, become one root in the same way.

The trees are worked by time-forward processing. Nodes are labelled level by level, so that a parent's label comes after
those of its children. A node sends its digest forward to its parent: a queue ordered by label delivers all digests of
a parent together. What a queue holds is bounded by cutting trees into bands of `BAND` levels: a task holds the queue of
one block of 2**BAND nodes, and what leaves a band is a table, shuffled by the block that it is sent to. Then the
sweep runs back, from the last label to the first: every node sends its children the proof from there to the root, and
every leaf receives its own.

Cases: a null field counts as `-` (an empty text is `0:`); rows with a null id come first in their group; equal ids are
ordered by digest, equal rows in any order, since their digests are the same; a null group is a group of its own and
the first; a group of one row has that row's digest as its root; an empty table gives an empty one; columns that are no
field are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmap.session import cut

#: Levels of a tree that one task works on at once.
BAND = 8
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW = (1 << 33) - 1
_LEFT, _RIGHT, _ALONE = b"L", b"R", b"-"


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest of consecutive nodes, which are joined as hexadecimal text."""
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    at = 0
    while at < len(path):
        side, at = path[at : at + 1], at + 1
        if side == _ALONE:
            digest = joined([digest])
            continue
        other, at = path[at : at + 32], at + 32
        digest = joined([other, digest] if side == _LEFT else [digest, other])
    return digest


def siblings(path: bytes) -> list[str]:
    """The digests of a path, leaf level first."""
    out, at = [], 0
    while at < len(path):
        if path[at : at + 1] == _ALONE:
            at += 1
        else:
            out.append(path[at + 1 : at + 33].hex())
            at += 33
    return out


def row_digest(fields: Sequence[Column]) -> Column:
    """The binary digest of one row's fields, each preceded by its length in bytes."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _levels(n: int) -> int:
    return min(BAND, (n - 1).bit_length())


def _forward(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests of every level of a block, from the leaves up: a parent is made when the queue delivers its children."""
    made: list[list[bytes]] = [digests] + [[] for _ in range(levels)]
    queue = [(1, at >> 1, at, digest) for at, digest in enumerate(digests)] if levels else []
    while queue:
        level, at, _, digest = heapq.heappop(queue)
        children = [digest]
        while queue and queue[0][:2] == (level, at):
            children.append(heapq.heappop(queue)[3])
        parent = joined(children)
        made[level].append(parent)
        if level < levels:
            heapq.heappush(queue, (level + 1, at >> 1, at, parent))
    return made


def _backward(made: list[list[bytes]], path: bytes) -> list[bytes]:
    """The path of every leaf of a block to the root, from the path of the block's top node."""
    above = [path]
    for level in range(len(made) - 2, -1, -1):
        nodes, below = made[level], []
        for at in range(len(nodes)):
            other = at ^ 1
            step = _ALONE if other >= len(nodes) else (_LEFT if other < at else _RIGHT) + nodes[other]
            below.append(step + above[at >> 1])
        above = below
    return above


def _rise(nodes: DataFrame, extra: Sequence[str]) -> DataFrame:
    """(tree, n, block, digest, made, <extra lists>): the blocks of one band of nodes (tree, n, idx, digest, <extra>)."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = "tree string, n long, block long, digest binary, made array<binary>" + "".join(f", {x} array<{kinds[x]}>" for x in extra)

    def up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n, tree = rows["n"][0].as_py(), rows["tree"][0].as_py()
        made = _forward(rows["digest"].to_pylist(), _levels(n))
        out = {"tree": [tree], "n": [n], "block": [rows["idx"][0].as_py() >> BAND], "digest": [made[-1][0]], "made": [[x for level in made for x in level]]}
        out |= {x: [rows[x].to_pylist()] for x in extra}
        return pa.table({k: pa.array(v, type=_arrow(schema)[k]) for k, v in out.items()})

    return nodes.withColumn("_block", F.shiftright("idx", BAND)).groupBy("tree", "_block").applyInArrow(up, schema)


def _arrow(schema: str) -> dict[str, pa.DataType]:
    plain = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return {name: plain[kind] for name, kind in (x.strip().split(" ") for x in schema.split(","))}


def _unpacked(made: list[bytes], size: int, levels: int) -> list[list[bytes]]:
    out, at = [], 0
    for _ in range(levels + 1):
        out.append(made[at : at + size])
        at, size = at + size, -(-size // 2)
    return out


def _sink(blocks: DataFrame, messages: DataFrame, extra: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(tree, idx, digest, path, subroot, root, <extra>) of the nodes below `blocks` from messages (tree, idx, path,
    subroot, root) to the blocks' top nodes."""
    schema = "tree string, idx long, digest binary, path binary, subroot binary, root binary" + "".join(f", {x} {kinds[x]}" for x in extra)
    kind = _arrow(schema)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row["n"])
                size = min(1 << BAND, row["n"] - (row["block"] << BAND))
                made = _unpacked(row["made"], size, levels)
                out = {"tree": [row["tree"]] * size, "idx": list(range(row["block"] << BAND, (row["block"] << BAND) + size)), "digest": made[0], "path": _backward(made, row["path"]), "subroot": [row["subroot"]] * size, "root": [row["root"]] * size}
                out |= {x: row[x] for x in extra}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kind.items()], list(kind))

    met = blocks.join(messages.withColumnRenamed("idx", "block"), ["tree", "block"])
    return met.select("tree", "n", "block", "made", "path", "subroot", "root", *extra).mapInArrow(down, schema)


def _climb(nodes: DataFrame, extra: Sequence[str]) -> list[DataFrame]:
    """The blocks of every band, lowest first; a tree's root is the digest of a block of at most 2**BAND nodes."""
    bands = []
    while True:
        blocks = cut(_rise(nodes, extra if not bands else ()))
        bands.append(blocks)
        open_ = blocks.filter(F.col("n") > 1 << BAND)
        if open_.isEmpty():
            return bands
        nodes = open_.select("tree", F.ceil(F.col("n") / F.lit(1 << BAND)).cast("long").alias("n"), F.col("block").alias("idx"), "digest")


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("n") <= 1 << BAND).select("tree", "digest")


def _descend(bands: list[DataFrame], start: DataFrame, extra: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """The nodes of the lowest band with their paths; start: (tree, path, subroot, root) of every tree."""
    from_above = None
    for level in range(len(bands) - 1, -1, -1):
        messages = start.join(_roots(bands[level]).select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
        if from_above is not None:
            messages = messages.unionByName(from_above.select("tree", "idx", "path", "subroot", "root"))
        from_above = _sink(bands[level], messages, () if level else extra, kinds)
    return from_above


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with idx, the place in its tree along `order`, and n, the tree's size. No tree is gathered: rows are sorted
    by ranges, and only (partition, tree) counts are summed."""
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_ROW)))
    runs = ordered.groupBy("_part", "tree").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")                                        # a row per partition at most
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("_part", "tree", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")))
    if runs.count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    return ordered.join(runs, ["_part", "tree"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, by: str = "lang", id_col: str = "doc_id", shown: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row; digests as lower-case hexadecimal text.

    `proof` has the sibling digests from the leaf to the root. `shown` is the digest (see `row_digest`) that a reader
    presents for a row, null for the row's own: it is folded with the proof, and verified where that gives the root.
    """
    group = F.col(by).cast("string")
    tree = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), group))      # "-" sorts before ":"
    own = F.lit(None).cast("binary") if shown is None else shown
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), tree.alias("tree"), row_digest([F.col(c) for c in fields]).alias("digest"), own.alias("shown"), F.monotonically_increasing_id().alias("tie")))
    placed = _placed(rows, ["id", "digest", "tie"]).select("tree", "n", "idx", "digest", "id", "shown")
    bands = _climb(placed, ["id", "shown"])
    subroots = _roots(bands[0])
    for band in bands[1:]:
        subroots = subroots.unionByName(_roots(band))
    top = _placed(subroots.withColumn("name", F.col("tree")).withColumn("tree", F.lit("")), ["name"]).select("tree", "n", "idx", "digest", "name")
    top_bands = _climb(top, ["name"])
    start = _roots(top_bands[-1]).select("tree", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    kinds = {"id": "bigint", "shown": "binary", "name": "string"}
    paths = _descend(top_bands, start, ["name"], kinds)
    starts = cut(paths.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    found = _descend(bands, starts, ["id", "shown"], kinds)
    names = ["id", "leaf", "subroot", "root", "proof", "folded_root"]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, leaf, seen = (batch.column(c).to_pylist() for c in ("path", "digest", "shown"))
            hexed = [pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for c in ("digest", "subroot", "root")]
            ends = [fold(b if c is None else c, a).hex() for a, b, c in zip(path, leaf, seen, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *hexed, pa.array([siblings(x) for x in path], pa.list_(pa.string())), pa.array(ends, pa.string())], names)

    out = found.select("id", "digest", "subroot", "root", "path", "shown").mapInArrow(folded, "id long, leaf string, subroot string, root string, proof array<string>, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)


def tampered_manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """`manifest` of documents, read with one character more counted where `every` divides the id's checksum."""
    touched = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return manifest(docs, shown=F.when(touched, row_digest(changed)))


#: The same rows in DuckDB: levels by recursion, proofs and folds along the ancestors of every leaf.
ORACLE_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, lang, coalesce(':' || lang, '-') AS tree, n_chars, source, text FROM documents
), hashed AS (
  SELECT *, sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
    || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
  FROM base
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
    CASE WHEN crc % 7 = 0 THEN sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-')
      || coalesce(strlen(text) || ':' || text, '-')) ELSE leaf END AS shown
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT doc_id, l.leaf, l.idx AS at, x.level, x.idx % 2 AS side, x.digest
  FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.idx = xor((l.idx // (2 ** x.level)::BIGINT)::BIGINT, 1)
  UNION ALL
  SELECT doc_id, l.leaf, l.idx, 1000 + t.level, t.idx % 2, t.digest
  FROM leaves l JOIN subroots s USING (tree) JOIN tops t ON t.n > 1 AND t.idx = xor((s.idx // (2 ** t.level)::BIGINT)::BIGINT, 1)
), levels AS (
  SELECT DISTINCT tree, level FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, 1000 + t.level FROM subroots s, (SELECT DISTINCT level FROM tops WHERE n > 1) t
), proofs AS (
  SELECT l.doc_id, l.leaf, l.idx AS at, any_value(l.shown) AS shown, sha256(coalesce(string_agg(s.digest, '' ORDER BY v.level), '')) AS proof_sha256,
    list({'side': s.side, 'digest': s.digest} ORDER BY v.level) FILTER (v.level IS NOT NULL) AS path, l.tree
  FROM leaves l LEFT JOIN levels v ON v.tree = l.tree
  LEFT JOIN steps s ON s.doc_id IS NOT DISTINCT FROM l.doc_id AND s.leaf = l.leaf AND s.at = l.idx AND s.level = v.level
  GROUP BY l.doc_id, l.leaf, l.idx, l.tree
), folded AS (
  SELECT *, list_reduce(list_prepend({'side': NULL::BIGINT, 'digest': shown}, coalesce(path, [])), lambda h, s: {'side': NULL::BIGINT, 'digest':
    sha256(CASE WHEN s.digest IS NULL THEN h.digest WHEN s.side = 0 THEN s.digest || h.digest ELSE h.digest || s.digest END)}).digest AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded JOIN subroots USING (tree) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
