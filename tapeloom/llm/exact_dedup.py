"""Exact duplicates through Patricia tries that own the full texts.

Two levels. Every input task inserts its normalised texts into a trie and hands on one row per distinct
text (the local owner), so a text that a third of all rows repeat crosses the shuffle once per task. The
owners are dealt by (length, content hash), and each task inserts them into one trie per length; a terminal
node holds the smallest row of its text and its number of copies. A trie beyond its memory budget gives up
its heaviest subtree: the rows of that subtree leave the task and are dealt again, by subtree, in a next pass.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import fresh, prepare, stage, thrifty
from tapeloom.llm.linking import SlotFilter

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD_SPACE = re.compile(r"[\x09-\x0D]|\x20\x20")
#: bytes of labels that one trie may hold
TRIE_BYTES = 48 << 20
NO_ID = (1 << 63) - 1


def normalise(text: str | None) -> str:
    if not text:
        return ""
    return SPACE.sub(" ", text) if ODD_SPACE.search(text) else text


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.kids, self.owner = label, {}, owner


def _common(label: bytes, key: bytes, at: int) -> int:
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over whole byte strings; a terminal node's ``owner`` is what ``make`` gave it."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def terminal(self, key: bytes, make):
        """The owner at ``key``, made on the first visit; None where ``key`` lies in a subtree given up."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(kid.label) + 200
                node, at = kid, len(key)
                break
            if kid.owner is GONE and key.startswith(kid.label, at):
                return None
            if not key.startswith(kid.label, at):
                n = _common(kid.label, key, at)
                fork = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = fork
                self.held += 200
            at += len(kid.label)
            node = kid
        if node.owner is GONE:
            return None
        if node.owner is None:
            node.owner = make()
        return node.owner

    def owners(self, node: Node | None = None, prefix: bytes = b""):
        """(key, owner) of every terminal below ``node``."""
        todo = [(node or self.root, prefix)]
        while todo:
            n, head = todo.pop()
            head += n.label
            if n.owner is not None and n.owner is not GONE:
                yield head, n.owner
            todo += [(kid, head) for kid in n.kids.values()]

    def _weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            n = todo.pop()
            total += len(n.label) + 200
            todo += n.kids.values()
        return total

    def give_up(self):
        """Cut the heaviest subtree below the first fork; returns (its prefix, [(key, owner)]), or None if one text is all."""
        node, prefix = self.root, b""
        while True:
            kids = [k for k in node.kids.values() if k.owner is not GONE]
            if not kids:
                return None
            if len(kids) > 1:
                break
            node, prefix = kids[0], prefix + kids[0].label
        kid = max(kids, key=self._weight)
        rows, weight = list(self.owners(kid, prefix)), self._weight(kid)
        kid.kids, kid.owner = {}, GONE
        self.held -= weight - len(kid.label) - 200
        return prefix + kid.label, rows


GONE = ("gone",)

OWNER = [
    ("tid", pa.int64()),
    ("size", pa.int64()),
    ("digest", pa.string()),
    ("body", pa.binary()),
    ("low_id", pa.int64()),
    ("low_row", pa.int64()),
    ("copies", pa.int64()),
]
MEMBER = ["rid", "tid", "size", "digest", "body", "low_id", "low_row", "copies"]


MEMBER_TYPES = [pa.int64()] * 3 + [pa.string(), pa.binary()] + [pa.int64()] * 3


def _local(carried: int, own_fields: list, budget: int):
    """Member rows (no body) and local owners (with body) of one input task."""

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        trie, seen, given, schema = Trie(), 0, 0, None

        def drain():
            rows = list(trie.owners()) if schema else []
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                blank = [pa.nulls(len(part), schema.field(j).type) for j in range(carried)]
                own = [o for _, o in part]
                yield pa.RecordBatch.from_arrays(
                    blank
                    + [
                        pa.nulls(len(part), pa.int64()),
                        pa.array([o[0] for o in own], pa.int64()),
                        pa.array([len(k) for k, _ in part], pa.int64()),
                        pa.array([o[1] for o in own], pa.string()),
                        pa.array([k for k, _ in part], pa.binary()),
                        pa.array([o[2] for o in own], pa.int64()),
                        pa.array([o[3] for o in own], pa.int64()),
                        pa.array([o[4] for o in own], pa.int64()),
                    ],
                    schema=schema,
                )

        for batch in batches:
            if schema is None:
                schema = pa.schema([*list(batch.schema)[:carried], *(pa.field(*f) for f in own_fields)])
            ids, texts = batch.column(carried).to_pylist(), batch.column(carried + 1).to_pylist()
            rids, tids, sizes, digests = [], [], [], []
            for doc_id, text in zip(ids, texts, strict=True):
                body = normalise(text).encode("utf-8", "surrogatepass")

                def make():
                    nonlocal given
                    given += 1
                    return [base | given, hashlib.sha256(body).hexdigest(), NO_ID, NO_ID, 0]

                own = trie.terminal(body, make)
                rid = base | seen
                seen += 1
                mine = (NO_ID if doc_id is None else doc_id, rid)
                if mine < (own[2], own[3]):
                    own[2], own[3] = mine
                own[4] += 1
                rids.append(rid)
                tids.append(own[0])
                sizes.append(len(body))
                digests.append(own[1])
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(j) for j in range(carried)]
                + [pa.array(rids, pa.int64()), pa.array(tids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
                + [pa.nulls(n, pa.binary())]
                + [pa.nulls(n, pa.int64())] * 3,
                schema=schema,
            )
            if trie.held > budget:
                yield from drain()
                trie = Trie()
        yield from drain()

    return thrifty(run)


def _settle(budget: int):
    """One trie per length over rows sorted by (size, digest); rows of subtrees given up leave with their subtree."""

    def run(batches):
        trie, size = Trie(), None
        schema = pa.schema([*OWNER, ("subtree", pa.string())])

        def drain():
            rows = []
            for key, own in trie.owners():
                for tid in own[3]:
                    rows.append((tid, len(key), None, None, own[0], own[1], own[2], None))
            yield from emit(rows)

        def emit(rows):
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], f.type) for j, f in enumerate(schema)], schema=schema)

        def spilled(prefix, found):
            mark = hashlib.sha256(prefix).hexdigest()
            for key, own in found:
                for tid, digest, low, row, copies in own[4]:
                    yield (tid, len(key), digest, key, low, row, copies, mark)

        for batch in batches:
            out = []
            for tid, n, digest, body, low, row, copies in zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True):
                if n != size:
                    yield from drain()
                    trie, size, marks = Trie(), n, []
                own = trie.terminal(body, lambda: [NO_ID, NO_ID, 0, [], []])
                if own is None:
                    mark = next(p for p in marks if body.startswith(p))
                    out.append((tid, n, digest, body, low, row, copies, hashlib.sha256(mark).hexdigest()))
                    continue
                if (low, row) < (own[0], own[1]):
                    own[0], own[1] = low, row
                own[2] += copies
                own[3].append(tid)
                own[4].append((tid, digest, low, row, copies))
                while trie.held > budget and (cut := trie.give_up()):
                    marks.append(cut[0])
                    out += spilled(*cut)
            yield from emit(out)
        yield from drain()

    return thrifty(run)


def _resolve(docs: DataFrame, id_col: str, text_col: str, carry: list[str], budget: int) -> tuple[DataFrame, DataFrame, dict]:
    """(members: one row per input row with its trie terminal, owners of the terminals, internal column names)."""
    prepare(docs.sparkSession)
    extra = [*MEMBER, "id", "text", "key", "low", "row", "total"]
    names = dict(zip(extra, fresh(docs.columns, *("_own_" + m for m in extra)), strict=True))
    source = docs.select(
        *(F.col(f"`{c}`") for c in carry),
        F.col(id_col).cast("long").alias(names["id"]),
        F.col(text_col).cast("string").alias(names["text"]),
    )
    kinds = [T.StructField(c, docs.schema[c].dataType) for c in carry]
    kinds += [T.StructField(names[m], T.LongType()) for m in ("rid", "tid", "size")]
    kinds += [T.StructField(names["digest"], T.StringType()), T.StructField(names["body"], T.BinaryType())]
    kinds += [T.StructField(names[m], T.LongType()) for m in ("low_id", "low_row", "copies")]
    spark_schema = T.StructType(kinds)
    own = [(names[m], t) for m, t in zip(MEMBER, MEMBER_TYPES, strict=True)]
    both = stage(source.mapInArrow(_local(len(carry), own, budget), spark_schema), "trie")
    members = both.where(F.col(names["rid"]).isNotNull())
    owners = both.where(F.col(names["rid"]).isNull()).select(*(F.col(names[n]).alias(n) for n, _ in OWNER))
    shape = "tid long, size long, digest string, body binary, low_id long, low_row long, copies long, subtree string"
    settled, dealt = None, ["size", "digest"]
    while True:
        done = stage(owners.repartition(*dealt).sortWithinPartitions("size", "digest").select(*(n for n, _ in OWNER)).mapInArrow(_settle(budget), shape), "owners")
        part = done.where("subtree is null").select("tid", "low_id", "low_row", "copies")
        settled = part if settled is None else settled.unionByName(part)
        owners, dealt = done.where("subtree is not null"), ["size", "subtree", "digest"]
        if owners.isEmpty():
            break
    renamed = zip(("tid", "low_id", "low_row", "copies"), ("key", "low", "row", "total"), strict=True)
    own = settled.select(*(F.col(a).alias(names[b]) for a, b in renamed))
    return members, own, names


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text counts
    as empty. The row with the smallest id stays; a null id comes after all others, and of rows repeated with
    one id exactly one stays. An empty table gives an empty result. Only the two named columns are read, so
    further columns can't clash.
    """
    id_name = fresh(docs.columns, "__doc")[0]
    slim = docs.select(F.col(id_col).cast("long").alias(id_name), F.col(text_col).alias("__body"))
    members, own, names = _resolve(slim, id_name, "__body", [id_name], budget)
    found = members.join(own, F.col(names["tid"]) == F.col(names["key"]))
    return found.select(
        F.col(id_name).alias("doc_id"),
        F.nullif(F.col(names["low"]), F.lit(NO_ID)).alias("keep_id"),
        F.col(names["total"]).alias("group_size"),
        (F.col(names["rid"]) == F.col(names["row"])).alias("kept"),
        F.col(names["digest"]).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see :func:`owners`).

    Only numbers are joined to tell who goes; texts are shuffled for rows that a bitmap of those takes for gone.
    """
    members, own, names = _resolve(docs, id_col, text_col, docs.columns, budget)
    rid = names["rid"]
    gone = members.select(rid, names["tid"]).join(own, F.col(names["tid"]) == F.col(names["key"])).where(F.col(rid) != F.col(names["row"]))
    gone = stage(gone.select(F.col(rid).alias(names["key"])), "gone")
    maybe = SlotFilter.of(gone.select(F.xxhash64(names["key"]).alias("slot"))).keeps(F.xxhash64(rid))
    asked = members.where(maybe).join(gone, F.col(rid) == F.col(names["key"]), "left_anti")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return members.where(~maybe).select(*kept).unionByName(asked.select(*kept))
