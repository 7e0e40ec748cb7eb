"""Read node-body files whose schema drifts into one consistent table, and list every change.

Method: similarity flooding. Each file becomes a schema graph of property
names, nesting and types. For every two neighbouring files of a feed the
pairwise graph starts from name and type similarities and, for the pairs of a
vanished and a new property, from how often a sketch of both (the values of the
same few nodes) agrees. Scores flow along the nesting and type edges until they
converge; the consistent one-to-one correspondences among the converged scores
are proposed as renames, and an exact comparison of all values verifies them.
Pairs that flooding did not propose, and of which an end is still free or whose
sketches do agree somewhere, are compared afterwards, so that no rename is lost
to a wrong score; `Drift.candidates` lists the pairs with what flooding made of
them. The strongest one-to-one choice among the verified renames maps every
property to the name it has in the newest file, to whose type the values are cast
before the union.

Input columns: ``body_id, feed, file_no, node_id, label, labels, props,
received_at`` (others are ignored). Rules: rows of one ``body_id`` count once
(the latest ``received_at``); rows without ``body_id``, ``feed`` or ``file_no``
belong to no file and are left out; null or undecodable ``props``, or props that
are not an object, hold no property but the record counts; a property belongs to
a file if at least a fifth of the records hold it, nulls included; its type is
the most frequent one of its non-null values and a file's label the most
frequent record label (ties: the alphabetically last); if a node has several
records in one file the last body id counts for comparing values; numbers compare
by value, so 1 equals 1.0. An empty table gives empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import materialize, running_total

#: A property belongs to a file when 1 of so many records holds it.
PRESENCE = 5
#: Tables of property names are broadcast up to so many bytes (names are free text, so rows alone are no measure).
BROADCAST_BYTES = 32_000_000
#: A sketch holds the values of about so many nodes of a file, at most twice as many on average.
SKETCH_NODES = 32
#: Correspondences are proposed from so large a share of the score an unchanged property reaches, and of the best score at either end.
PROPOSED, RELATIVE = 0.25, 0.8
#: Working memory of one batch of flooded schema pairs.
FLOOD_BYTES = 64_000_000
#: A hot file is spread over so many keys where pairs are joined with values.
SALTS = 16

_PARSED = "feed string, file_no int, node_id bigint, body_id bigint, path string, kind string, value bigint, label string"
_PARSED_ARROW = pa.schema(
    [
        ("feed", pa.string()),
        ("file_no", pa.int32()),
        ("node_id", pa.int64()),
        ("body_id", pa.int64()),
        ("path", pa.string()),
        ("kind", pa.string()),
        ("value", pa.int64()),
        ("label", pa.string()),
    ]
)


def _canonical(value: object) -> object:
    """`value` with numbers in one spelling, so that equal values have equal JSON text."""
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()}
    return value


def _kind_and_text(value: object) -> tuple[str, str]:
    if value is None:
        return "null", ""
    if value is True:
        return "boolean", "true"
    if value is False:
        return "boolean", "false"
    if isinstance(value, str):
        return "string", "s" + value
    if isinstance(value, int):
        return "integer", repr(value)
    if isinstance(value, float):
        return "float", repr(int(value)) if value.is_integer() else repr(value)
    return "list", json.dumps(_canonical(value), sort_keys=True)


def _big_int(digits: str) -> int | float:
    return int(digits) if len(digits) < 4000 else float("inf")


_decoder = json.JSONDecoder(parse_int=_big_int)


def _properties(props: str | None) -> Iterator[tuple[str, object]]:
    if props is None:
        return
    try:
        record = _decoder.decode(props)
    except (ValueError, RecursionError):
        return
    if not isinstance(record, dict):
        return
    for name, value in record.items():
        if isinstance(value, dict):
            for inner, leaf in value.items():
                yield f"{name}.{inner}", leaf
        else:
            yield name, value


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record (without path, with its label) and one per property."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        at, path, kind, value = [], [], [], []
        for i, props in enumerate(batch["props"].to_pylist()):
            at.append(i)
            path.append(None)
            kind.append(None)
            value.append(0)
            for name, leaf in _properties(props):
                k, text = _kind_and_text(leaf)
                at.append(i)
                path.append(name)
                kind.append(k)
                value.append(digest(text.encode("utf-8", "surrogatepass")))
        take = pa.array(at, pa.int32())
        record = pa.array([p is None for p in path], pa.bool_())
        label = pa.compute.if_else(record, batch["label"].take(take), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [
                batch["feed"].take(take),
                batch["file_no"].take(take),
                batch["node_id"].take(take),
                batch["body_id"].take(take),
                pa.array([p and p.encode("utf-8", "replace").decode() for p in path], pa.string()),
                pa.array(kind, pa.string()),
                pa.array(np.array(value, np.uint64).view(np.int64)),
                label,
            ],
            schema=_PARSED_ARROW,
        )


def _records(bodies: DataFrame) -> DataFrame:
    """One row per body id with its label."""
    label = F.coalesce("label", F.get(F.col("labels"), F.lit(0)))
    own = bodies.where(F.col("body_id").isNotNull() & F.col("feed").isNotNull() & F.col("file_no").isNotNull()).select(
        F.col("body_id").cast("bigint"),
        "received_at",
        "feed",
        F.col("file_no").cast("int"),
        F.col("node_id").cast("bigint"),
        label.alias("label"),
        "props",
    )
    fields = ["feed", "file_no", "node_id", "label", "props"]
    return own.groupBy("body_id").agg(F.max(F.struct("received_at", *fields)).alias("b")).select("body_id", *[f"b.{f}" for f in fields])


def _file_schemas(parsed: DataFrame) -> DataFrame:
    """``(feed, file_no, label, records, props array<struct<path, kind>>)``; its rows are as wide as a schema."""
    tally = materialize(parsed.groupBy("feed", "file_no", "path", "kind", "label").agg(F.count(F.lit(1)).alias("n")))
    files = tally.where(F.col("path").isNull()).groupBy("feed", "file_no").agg(
        F.sum("n").alias("records"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("label")
    )
    files = files.select("feed", "file_no", "records", "label.label")
    by_path = tally.where(F.col("path").isNotNull()).groupBy("feed", "file_no", "path").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("kind") != "null", F.struct("n", "kind"))).alias("kind")
    )
    # Only paths that belong to the file are gathered: at most PRESENCE times as many as a record holds on average.
    held = by_path.join(files.select("feed", "file_no", "records"), ["feed", "file_no"]).where(F.col("n") * PRESENCE >= F.col("records"))
    wide = held.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct("path", F.col("kind.kind").alias("kind")))).alias("props"))
    none = F.array().cast("array<struct<path:string,kind:string>>")
    return files.join(wide, ["feed", "file_no"], "left").select("feed", "file_no", "label", "records", F.coalesce("props", none).alias("props"))


def _neighbours(schemas: DataFrame) -> DataFrame:
    """Each file with the one before it in its feed."""
    ranked = materialize(
        running_total(schemas.withColumn("_one", F.lit(1)), ["feed"], ["file_no"], "_one", "seq").drop("_one")
    )
    earlier = ranked.select(
        "feed",
        (F.col("seq") + 1).alias("seq"),
        F.col("file_no").alias("old_file"),
        F.col("label").alias("old_label"),
        F.col("records").alias("old_records"),
        F.col("props").alias("old_props"),
    )
    return ranked.join(earlier, ["feed", "seq"])


# ---- similarity flooding -------------------------------------------------------------


def _grams(name: str) -> set[str]:
    bare = "".join(c for c in name.lower() if c.isalnum())
    padded = f"^{bare}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, case and separators aside."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


class SchemaGraph:
    """Root, inner objects, properties and types of one file, with labelled edges between them."""

    def __init__(self, props: list[tuple[str, str | None]]):
        self.names: list[tuple[str, str]] = [("root", "")]
        index = {("root", ""): 0}

        def vertex(kind: str, name: str) -> int:
            if (kind, name) not in index:
                index[kind, name] = len(self.names)
                self.names.append((kind, name))
            return index[kind, name]

        edges: dict[str, list[tuple[int, int]]] = {"property": [], "type": []}
        for path, kind in props:
            head, dot, _ = path.partition(".")
            parent = 0
            if dot:
                known = ("object", head) in index
                parent = vertex("object", head)
                if not known:
                    edges["property"].append((0, parent))
            leaf = vertex("property", path)
            edges["property"].append((parent, leaf))
            edges["type"].append((leaf, vertex("type", kind or "unknown")))
        self.size = len(self.names)
        self.edges = edges

    def matrix(self, label: str, size: int) -> np.ndarray:
        m = np.zeros((size, size))
        for a, b in self.edges[label]:
            m[a, b] = 1.0
        return m


#: Sketch of a pair of properties: nodes with a value of both, and how many of these agree.
Evidence = dict[tuple[str, str], tuple[int, int]]


def _start(a: SchemaGraph, b: SchemaGraph, evidence: Evidence) -> np.ndarray:
    """Initial similarities: names, types and, where two properties were sketched, the share of equal values."""
    s = np.zeros((a.size, b.size))
    for i, (kind, name) in enumerate(a.names):
        for j, (other, own) in enumerate(b.names):
            if kind != other:
                continue
            if kind == "root":
                s[i, j] = 1.0
            elif kind == "type":
                s[i, j] = float(name == own)
            elif name == own:
                s[i, j] = 1.0
            elif (name, own) in evidence:
                both, equal = evidence[name, own]
                s[i, j] = 0.05 + 0.15 * name_similarity(name, own) + 0.8 * (equal + 0.5) / (both + 1)
            else:
                s[i, j] = 0.05 + 0.5 * name_similarity(name, own)
    return s


def flood(
    pairs: list[tuple[SchemaGraph, SchemaGraph]], evidence: list[Evidence] | None = None, tolerance: float = 1e-3, most: int = 100
) -> tuple[list[np.ndarray], bool]:
    """Similarity matrices, computed for all pairs together in padded batches, and whether they converged within `most` rounds.

    One step is s <- normalise(s0 + s + flow(s0 + s)): along each edge label the
    flow of a vertex pair is shared evenly among the pairs it points to, forwards
    and backwards; in matrix form A' S B with row-normalised adjacency matrices.
    """
    if not pairs:
        return [], True
    n, m = max(a.size for a, _ in pairs), max(b.size for _, b in pairs)
    start = np.zeros((len(pairs), n, m))
    for k, (a, b) in enumerate(pairs):
        start[k, : a.size, : b.size] = _start(a, b, evidence[k] if evidence else {})
    flows = []
    for label in ("property", "type"):
        left = np.stack([a.matrix(label, n) for a, _ in pairs])
        right = np.stack([b.matrix(label, m) for _, b in pairs])
        for x, y in ((left, right), (left.transpose(0, 2, 1), right.transpose(0, 2, 1))):
            x = x / np.maximum(x.sum(2, keepdims=True), 1)
            y = y / np.maximum(y.sum(2, keepdims=True), 1)
            flows.append((x.transpose(0, 2, 1), y))
    s, settled = start, False
    for _ in range(most):
        base = start + s
        new = base + sum(x @ base @ y for x, y in flows)
        new /= np.maximum(new.max((1, 2), keepdims=True), 1e-12)
        moved = np.abs(new - s).max()
        s = new
        if moved < tolerance:
            settled = True
            break
    return [s[k, : a.size, : b.size] for k, (a, b) in enumerate(pairs)], settled


def consistent_choice(score: np.ndarray, usual: float) -> list[tuple[int, int]]:
    """One-to-one correspondences of a score matrix, strongest first: no pair is taken from an end that has a clearly better one.

    `usual` is the score of properties that did not change.
    """
    best_row, best_column = score.max(1, initial=0.0), score.max(0, initial=0.0)
    order = np.argsort(-score, axis=None, kind="stable")
    taken_rows, taken_columns, out = set(), set(), []
    for i, j in zip(*np.unravel_index(order, score.shape)):
        if score[i, j] < PROPOSED * usual:
            break
        if i not in taken_rows and j not in taken_columns and score[i, j] >= RELATIVE * max(best_row[i], best_column[j]):
            taken_rows.add(i)
            taken_columns.add(j)
            out.append((int(i), int(j)))
    return out


_CANDIDATES = "feed string, old_file int, file_no int, old_name string, new_name string, score double, proposed boolean, likely boolean, settled boolean"


def _batches_of(rows: list, size) -> Iterator[list]:
    """Runs of rows whose padded matrices stay within FLOOD_BYTES, one row at least."""
    run, widest = [], 0
    for row in sorted(rows, key=size):
        widest = max(widest, size(row))
        if run and (len(run) + 1) * widest * widest * 8 * 12 > FLOOD_BYTES:
            yield run
            run, widest = [], size(row)
        run.append(row)
    if run:
        yield run


def _correspondences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        # Two vertices for every property (itself, perhaps an object) and the root and types at most.
        for rows in _batches_of(list(frame.itertuples(index=False)), lambda r: 2 * max(len(r.old_props), len(r.props)) + 8):
            graphs = [
                tuple(SchemaGraph([(p["path"], p["kind"]) for p in props]) for props in (r.old_props, r.props)) for r in rows
            ]
            evidence = [{(e["old_name"], e["new_name"]): (e["both"], e["equal"]) for e in r.evidence} for r in rows]
            scores, settled = flood(graphs, evidence)
            for r, (a, b), s, known in zip(rows, graphs, scores, evidence):
                left = {x: i for i, (k, x) in enumerate(a.names) if k == "property"}
                right = {x: j for j, (k, x) in enumerate(b.names) if k == "property"}
                old = [(i, x) for x, i in left.items() if x not in right]
                new = [(j, x) for x, j in right.items() if x not in left]
                kept = [s[left[x], right[x]] for x in left if x in right]
                sub = s[np.ix_([i for i, _ in old], [j for j, _ in new])]
                chosen = set(consistent_choice(sub, float(np.median(kept)) if kept else float(sub.max(initial=0.0))))
                for i, j in np.ndindex(*sub.shape):
                    both, equal = known.get((old[i][1], new[j][1]), (0, 0))
                    likely = equal > 0 or both < 8
                    out.append((r.feed, r.old_file, r.file_no, old[i][1], new[j][1], float(sub[i, j]), (i, j) in chosen, likely, settled))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in _CANDIDATES.split(", ")])


# ---- values of vanished and new properties ----------------------------------------------


def _fits(df: DataFrame, *texts: str) -> bool:
    """Whether a table of names is small enough to be sent to every executor."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(64))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _values(parsed: DataFrame, open_steps: DataFrame, gone: Column, come: Column) -> DataFrame:
    """``(feed, file_no, path, node_id, value)`` of the properties that vanish from or are new in a file, one row per node."""
    wanted = (
        open_steps.select("feed", F.col("old_file").alias("file_no"), F.explode(gone).alias("path"))
        .union(open_steps.select("feed", "file_no", F.explode(come).alias("path")))
        .distinct()
    )
    wanted = materialize(wanted)
    return (
        parsed.where(F.col("path").isNotNull() & (F.col("kind") != "null") & F.col("node_id").isNotNull())
        .select("feed", "file_no", "path", "node_id", "body_id", "value")
        .join(F.broadcast(wanted) if _fits(wanted, "feed", "path") else wanted, ["feed", "file_no", "path"], "left_semi")
        .groupBy("feed", "file_no", "path", "node_id")
        .agg(F.max_by("value", "body_id").alias("value"))
    )


def _sketched(values: DataFrame, open_steps: DataFrame) -> DataFrame:
    """``(feed, file_no, evidence)``: how the sketches of a step's properties agree.

    Both files of a step keep the nodes whose hash ends in as many zero bits as
    leave about SKETCH_NODES of the larger one, so the sketches hold the same nodes.
    """
    bits = lambda n: F.greatest(F.lit(0), F.floor(F.log2(F.col(n) / F.lit(2.0 * SKETCH_NODES))) + 1)
    steps = open_steps.select("feed", "old_file", "file_no", F.pow(F.lit(2), F.greatest(bits("records"), bits("old_records"))).cast("bigint").alias("part"))
    few = _fits(steps, "feed")
    near = lambda side: F.broadcast(side) if few else side
    sample = lambda n: F.pmod(F.xxhash64("node_id"), F.col(n)) == 0
    old = values.join(near(steps.withColumnRenamed("file_no", "new_file").withColumnRenamed("old_file", "file_no")), ["feed", "file_no"])
    old = old.where(sample("part")).select("feed", F.col("new_file").alias("file_no"), F.col("path").alias("old_name"), "node_id", F.col("value").alias("old_value"))
    new = values.join(near(steps.drop("old_file")), ["feed", "file_no"]).where(sample("part"))
    new = new.select("feed", "file_no", F.col("path").alias("new_name"), "node_id", F.col("value").alias("new_value"))
    counts = _tally(old.join(new, ["feed", "file_no", "node_id"]), "feed", "file_no", "old_name", "new_name")
    return counts.groupBy("feed", "file_no").agg(F.collect_list(F.struct("old_name", "new_name", "both", "equal")).alias("evidence"))


def _tally(pairs: DataFrame, *keys: str) -> DataFrame:
    """Nodes with both values, and with equal ones."""
    same = F.sum((F.col("old_value") == F.col("new_value")).cast("int"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("both"), same.alias("equal"))


def _agreeing(values: DataFrame, proposed: DataFrame) -> DataFrame:
    """Those pairs whose values are equal for more than half of the nodes with both."""
    step = ["feed", "old_file", "file_no", "old_name", "new_name", "score"]
    pairs = proposed.select(*step)
    few = _fits(pairs, "feed", "old_name", "new_name")
    old = values.select("feed", F.col("file_no").alias("old_file"), F.col("path").alias("old_name"), "node_id", F.col("value").alias("old_value"))
    new = values.select("feed", "file_no", F.col("path").alias("new_name"), "node_id", F.col("value").alias("new_value"))
    if few:
        left = old.join(F.broadcast(pairs), ["feed", "old_file", "old_name"])
    else:  # a file may hold a third of all rows, so its keys are split
        salted = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = old.withColumn("_salt", F.pmod(F.hash("node_id"), F.lit(SALTS))).join(salted, ["feed", "old_file", "old_name", "_salt"]).drop("_salt")
    return _tally(left.join(new, ["feed", "file_no", "new_name", "node_id"]), *step).where(F.col("equal") * 2 > F.col("both"))


@dataclass
class Drift:
    """What `trace` finds; all members are DataFrames."""

    #: ``(feed, file_no, change, old_name, new_name)``
    changes: DataFrame
    #: ``(feed, old_file, file_no, old_name, new_name, score, both, equal)`` of verified renames
    renames: DataFrame
    #: ``(feed, file_no, label, records, props)``: the schema of each file
    schemas: DataFrame
    #: ``(feed, old_file, file_no, old_name, new_name, score, proposed, likely, settled)`` of every pair of a vanished and a new
    #: property: its converged score, whether flooding proposes it, whether the sketches leave it open, whether the scores converged
    candidates: DataFrame


def trace(bodies: DataFrame) -> Drift:
    """All changes between neighbouring files of every feed."""
    return _trace(_records(bodies))


def _trace(records: DataFrame) -> Drift:
    parsed = materialize(records.mapInArrow(_parse, _PARSED))
    schemas = materialize(_file_schemas(parsed))
    steps = materialize(_neighbours(schemas))
    paths = lambda c: F.transform(c, lambda p: p["path"])
    gone = F.array_except(paths("old_props"), paths("props"))
    come = F.array_except(paths("props"), paths("old_props"))
    open_steps = steps.where((F.size(gone) > 0) & (F.size(come) > 0))
    values = materialize(_values(parsed, open_steps, gone, come))
    no_evidence = F.array().cast("array<struct<old_name: string, new_name: string, both: bigint, equal: bigint>>")
    graphs = open_steps.join(_sketched(values, open_steps), ["feed", "file_no"], "left").select(
        "feed", "old_file", "file_no", "old_props", "props", F.coalesce("evidence", no_evidence).alias("evidence")
    )
    candidates = materialize(graphs.mapInPandas(_correspondences, _CANDIDATES))
    renames = materialize(_agreeing(values, candidates.where("proposed")))
    # What flooding passed over is compared where an end is free, or where the sketches do not speak against it.
    end = lambda n: renames.select("feed", "file_no", n, F.lit(True).alias(f"{n}_taken")).distinct()
    rest = candidates.where("NOT proposed").join(end("old_name"), ["feed", "file_no", "old_name"], "left").join(end("new_name"), ["feed", "file_no", "new_name"], "left")
    rest = materialize(rest.where("likely OR old_name_taken IS NULL OR new_name_taken IS NULL").select(*candidates.columns))
    renames = renames.unionByName(materialize(_agreeing(values, rest)))
    by_file = renames.groupBy("feed", "file_no").agg(
        F.collect_set("old_name").alias("from_names"), F.collect_set("new_name").alias("to_names")
    )
    none = F.array().cast("array<string>")
    both = steps.join(by_file, ["feed", "file_no"], "left").select(
        "feed",
        "file_no",
        F.array_except(gone, F.coalesce("from_names", none)).alias("gone"),
        F.array_except(come, F.coalesce("to_names", none)).alias("come"),
        F.filter(
            F.transform(
                F.filter("old_props", lambda p: p["kind"].isNotNull()),
                lambda p: F.struct(
                    p["path"].alias("path"),
                    F.exists("props", lambda q: (q["path"] == p["path"]) & (q["kind"] != p["kind"])).alias("differs"),
                ),
            ),
            lambda p: p["differs"],
        ).alias("retyped"),
        "label",
        "old_label",
    )
    row = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_name"), new.alias("new_name"))
    empty = F.lit("")
    listed = F.concat(
        F.transform("gone", lambda x: row("removed", x, empty)),
        F.transform("come", lambda x: row("added", empty, x)),
        F.transform("retyped", lambda x: row("type_changed", x["path"], x["path"])),
        F.when(F.col("label") != F.col("old_label"), F.array(row("relabelled", F.col("old_label"), F.col("label")))).otherwise(
            F.array().cast("array<struct<change:string,old_name:string,new_name:string>>")
        ),
    )
    changes = both.select("feed", "file_no", F.inline(listed)).unionByName(
        renames.select("feed", "file_no", F.lit("renamed").alias("change"), "old_name", "new_name")
    )
    return Drift(changes, renames, schemas, candidates)


_TABLE = "body_id bigint, feed string, file_no int, node_id bigint, label string, props map<string, struct<kind: string, text: string, stray: string>>"
_PROPS = pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string()), ("stray", pa.string())]))


def _cast(kind: str, text: str, to: str | None) -> str | None:
    """The text of a value after a cast to the type `to`, None if it does not cast."""
    if to in (None, "string") or to == kind != "float":
        return text
    if to == "list":
        return json.dumps([text])
    if to == "boolean":
        return text.lower() if text.lower() in ("true", "false") else None
    try:
        if to == "integer" and re.fullmatch(r"[+-]?\d{1,4000}", text, re.ASCII):
            return str(int(text))  # not by way of a float, which has 53 bits only
        number = float(text)
    except ValueError:
        return None
    if to == "float":
        return repr(number)
    return str(int(number)) if number.is_integer() else None


def _translator(shared: Broadcast | None):
    """Records under their new names and types; the rules come with the task (`shared`) or, where there are too many, with each record."""

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict[str, tuple[str, str | None]]] = {} if shared is None else shared.value
        for batch in batches:
            out = []
            feeds, files = batch["feed"].to_pylist(), batch["file_no"].to_pylist()
            for i, props in enumerate(batch["props"].to_pylist()):
                key = (feeds[i], files[i])
                if shared is None and key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = {x["path"]: (x["name"], x["to_kind"]) for x in batch["names"][i].as_py() or ()}
                rules = known.get(key, {})
                row: dict[str, dict] = {}
                for path, leaf in _properties(props):
                    kind, text = _kind_and_text(leaf)
                    name, to = rules.get(path, (path, None if kind == "null" else kind))
                    text = text[1:] if kind == "string" else text
                    value = None if kind == "null" else _cast(kind, text, to)
                    # Two old names may meet under one new name in a stray record: a value that casts wins, then the larger text.
                    if name not in row or value is not None and (row[name]["text"] is None or value > row[name]["text"]):
                        stray = text if value is None and kind != "null" else None
                        clean = lambda t: t and t.encode("utf-8", "replace").decode()
                        row[name] = {"kind": to, "text": clean(value), "stray": clean(stray)}
                out.append(list(row.items()))
            columns = [batch[n] for n in ("body_id", "feed", "file_no", "node_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _PROPS)], names=["body_id", "feed", "file_no", "node_id", "label", "props"])

    return translate


def consistent_names(drift: Drift, rounds: int = 64) -> DataFrame:
    """``(feed, file_no, path, name)``: the name each property of each file has in the newest file it reaches.

    Of several verified renames of one property the one with the strongest score
    counts, and a new name is taken from its strongest source only. Chains of
    renames are followed by pointer doubling, so `rounds` bounds their length at
    2**rounds.
    """
    schemas = drift.schemas
    props = schemas.select("feed", "file_no", F.inline("props")).select("feed", "file_no", "path")
    strongest = F.struct("score", "equal", "new_name")
    best = (
        drift.renames.groupBy("feed", "old_file", "file_no", "old_name")
        .agg(F.max(strongest).alias("r"))
        .groupBy("feed", "old_file", "file_no", F.col("r.new_name").alias("new_name"))
        .agg(F.max_by("old_name", F.col("r.score")).alias("old_name"))
    )
    # A step leads from (file, path) to the next file's path; unchanged names need no step of their own:
    # a name is followed to the first later file in which it is renamed.
    renamed = best.select("feed", "old_file", F.col("file_no").alias("next_file"), F.col("old_name").alias("path"), F.col("new_name").alias("next_path"))
    hop = (
        props.join(renamed, ["feed", "path"], "left")
        .where(F.col("old_file").isNull() | (F.col("old_file") >= F.col("file_no")))
        .groupBy("feed", "file_no", "path")
        .agg(F.min(F.struct("old_file", "next_file", "next_path")).alias("s"))
    )
    links = materialize(
        props.join(hop, ["feed", "file_no", "path"], "left").select(
            "feed",
            "file_no",
            "path",
            F.coalesce("s.next_file", "file_no").alias("to_file"),
            F.coalesce("s.next_path", "path").alias("name"),
        )
    )
    for _ in range(rounds):
        ahead = links.select(
            "feed",
            F.col("file_no").alias("to_file"),
            F.col("path").alias("name"),
            F.col("to_file").alias("far_file"),
            F.col("name").alias("far_name"),
        )
        new = materialize(
            links.join(ahead, ["feed", "to_file", "name"], "left").select(
                "feed",
                "file_no",
                "path",
                F.coalesce("far_file", "to_file").alias("to_file"),
                F.coalesce("far_name", "name").alias("name"),
                (F.coalesce("far_file", "to_file") != F.col("to_file")).alias("moved"),
            )
        )
        links = new.drop("moved")
        if not new.where("moved").take(1):
            break
    return links.select("feed", "file_no", "path", "name")


def consistent_table(bodies: DataFrame, drift: Drift | None = None) -> DataFrame:
    """Every record of every file under consistent names and types.

    ``(body_id, feed, file_no, node_id, label, props map<string, struct<kind,
    text, stray>>)``: keys are the newest names, ``kind`` the type of that property in
    the newest file that holds it and ``text`` the value, null where it does not
    cast to that type; then ``stray`` keeps the text it had. Properties that no
    file's schema holds keep their name.
    """
    records = _records(bodies)
    if drift is None:
        records = materialize(records)  # read twice: for the schemas and for the result
        drift = _trace(records)
    names = consistent_names(drift)
    named = names.join(drift.schemas.select("feed", "file_no", F.inline("props")), ["feed", "file_no", "path"])
    kinds = named.groupBy("feed", "name").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("file_no"))).alias("to_kind"))
    rules = names.join(kinds, ["feed", "name"]).select("feed", "file_no", "path", "name", "to_kind")
    rules = materialize(rules)
    if _fits(rules, "feed", "path", "name"):
        by_file: dict[tuple, dict[str, tuple[str, str | None]]] = {}
        for r in rules.collect():  # at most BROADCAST_BYTES
            by_file.setdefault((r.feed, r.file_no), {})[r.path] = (r.name, r.to_kind)
        return records.mapInArrow(_translator(bodies.sparkSession.sparkContext.broadcast(by_file)), _TABLE)
    # One row per file, as wide as its schema: the records themselves are neither exploded nor regrouped.
    maps = rules.groupBy("feed", "file_no").agg(F.collect_list(F.struct("path", "name", "to_kind")).alias("names"))
    return records.join(maps, ["feed", "file_no"], "left").mapInArrow(_translator(None), _TABLE)
