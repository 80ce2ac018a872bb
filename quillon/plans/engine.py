"""Runs the dialect: checks names and types here, leaves plans and execution to Spark.

Tables are frames that are attached, or managed ones: Parquet folders below a warehouse
path. INSERT adds a folder, DELETE and UPDATE write the rest anew; readers keep the folders
that they opened. Indexes are folders beside them, made when they are created and made anew
by the first search after a change.
"""

from __future__ import annotations

import contextlib
import datetime
import io
import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from quillon.functions.spatial import distance, in_polygon, radius_box
from quillon.functions.text import SPANISH
from quillon.operators import search, text_index
from quillon.operators.gallery import numbered

from .dialect import ParseError, parse
from .explain import Node, expected, share
from .locks import Locks, LockTimeout

TYPES = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "VARCHAR": T.StringType(), "DATE": T.StringType(), "TEXT": T.StringType(), "POINT": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]), "VECTOR": T.ArrayType(T.FloatType())}
NUMBERS = ("INT", "FLOAT")
STRINGS = ("VARCHAR", "TEXT", "DATE")
FLOAT_MOST = 3.4028234663852886e38
RID = "_rid"
#: Folders of a table before an insert writes them as one; degrees of a tile that points are stored by.
FOLDERS, TILE = 16, 0.05
# Bytes that a stored record may have; what a value of each type, and the record itself, take.
RECORD_MOST, RECORD_OWN = 4080, 16
BYTES = {"INT": 4, "FLOAT": 4, "DATE": 32, "TEXT": 12, "POINT": 16, "VECTOR": 0}
#: After this many changes, and this share of the rows, statistics are made anew.
CHANGES, CHANGED_SHARE = 50, 0.1


class SemanticError(ValueError):
    """A statement that parses but can't be run."""


@dataclass
class Table:
    name: str
    columns: list[dict]
    frame: DataFrame
    managed: bool = False
    version: int = 0
    layout: str | None = None
    indexes: dict[str, dict] = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)
    folder: str | None = None
    parts: list[str] = field(default_factory=list)
    past: list[str] = field(default_factory=list)
    last_rid: int = 0
    rows: int | None = None
    changes: int = 0
    analyzed: bool = False
    ordered_by: str | None = None

    def column(self, name: str) -> dict:
        found = next((c for c in self.columns if c["name"] == name), None)
        if not found:
            raise SemanticError(f"{self.name} has no column {name}")
        return found


@dataclass
class Result:
    kind: str
    frame: DataFrame | None = None
    affected: int | None = None
    error: str | None = None
    report: str | None = None
    note: str | None = None
    plan: Node | None = None


def _kind(data: T.DataType) -> str:
    if isinstance(data, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(data, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(data, T.ArrayType):
        return "VECTOR"
    return "POINT" if isinstance(data, T.StructType) else "TEXT"


def _schema(columns: list[dict]) -> T.StructType:
    return T.StructType([*[T.StructField(c["name"], TYPES[c["type"]]) for c in columns], T.StructField(RID, T.LongType())])


def _touched(s: dict) -> dict[str, str]:
    """The tables that a statement reads (shared), searches for rows to change (update) or changes."""
    if s["kind"] == "explain":
        found = _touched(s["statement"])
        return found if s["analyze"] else dict.fromkeys(found, "PS")
    if s["kind"] == "select":
        return {source["table"]: "PS" for source in s["sources"]}
    if s["kind"] in ("update", "delete"):
        return {s["table"]: "PU"}
    return {s[k]: "PX" for k in ("table",) if k in s} | ({s["name"]: "PX"} if s["kind"] == "drop_table" else {})


#: What a saved catalogue keeps of a table.
SAVED = ("name", "columns", "version", "layout", "indexes", "statistics", "folder", "parts", "past", "last_rid", "rows", "changes", "analyzed", "ordered_by")


class Tables(dict):
    """Tables by name; those that are attached for later are made when they are asked for."""

    def __init__(self):
        super().__init__()
        self._later: dict[str, Callable[[], Table]] = {}

    def later(self, name: str, make: Callable[[], Table]) -> None:
        self._later[name] = make

    def names(self) -> list[str]:
        return sorted({*self, *self._later})

    def __bool__(self) -> bool:
        return bool(len(self) or self._later)

    def __contains__(self, name) -> bool:
        return super().__contains__(name) or name in self._later

    def __missing__(self, name):
        self[name] = self._later.pop(name)()
        return self[name]


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str | None = None, parameters: dict[str, tuple[float, float]] | None = None, locks: Locks | None = None, analysis: dict | None = None, vectorizer: Callable[[str, str], list[float]] | None = None):
        """``analysis`` tells how MATCH makes terms: without stop words and of stems, or as ``terms`` takes it.

        ``vectorizer`` makes a vector of (name of a table, path of a file) for SIMILAR_TO('file', ...).
        """
        self.spark, self.warehouse, self.parameters = spark, warehouse, parameters or {}
        self.locks = locks or Locks()
        self.analysis = SPANISH if analysis is None else analysis
        self.vectorizer = vectorizer
        self.tables: dict[str, Table] = Tables()
        self.open = False
        self.note: str | None = None
        self.counting: dict[str, Observation] | None = None

    def attach(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        """Make a frame readable as a table; its types tell the dialect's types.

        A function that gives the frame is called when the table is first used.
        """
        if callable(frame):
            self.tables.later(name, lambda: self._attached(name, frame()))
        else:
            self.tables[name] = self._attached(name, frame)

    def _attached(self, name: str, frame: DataFrame) -> Table:
        return Table(name, [{"name": f.name, "type": _kind(f.dataType), "size": None, "key": False, "required": False, "double": isinstance(f.dataType, (T.DoubleType, T.DecimalType, T.LongType))} for f in frame.schema], frame)

    def query(self, text: str) -> DataFrame:
        """The frame of one SELECT; errors are raised."""
        (statement,) = parse(text)
        self.note = None
        return self._select(statement)

    def sql(self, text: str) -> list[Result]:
        """Run a batch: a statement that fails reports its error, later ones still run."""
        out = []
        return [self.run(s) for s in parse(text)]

    def run(self, s: dict) -> Result:
        """The result of one statement, or its error."""
        self.note = None
        try:
            for table, mode in _touched(s).items():
                self.locks.acquire(self, table, mode)
            out = getattr(self, f"_do_{s['kind']}")(s)
            out.note = self.note
        except (SemanticError, LockTimeout) as e:
            out = Result(s["kind"], error=str(e))
        finally:
            if not self.open:
                self.locks.release(self)
        return out

    def respond(self, text: str) -> dict:
        """What a client gets for a batch: plain values, a part for each statement, times in ms.

        The first error stands in front. A transaction has to begin and end in one batch. All
        rows of each SELECT are given: ask with LIMIT for fewer.
        """
        began = time.perf_counter()
        try:
            statements = parse(text)
        except ParseError as e:
            return {"error": str(e), "statements": []}
        depth = 0
        for s in statements:
            depth += {"begin": 1, "end": -1}.get(s["kind"], 0)
            if depth not in (0, 1):
                return {"error": "transactions don't nest, and end after they begin", "statements": []}
        if depth:
            return {"error": "a transaction begins and ends in one batch", "statements": []}
        parts = [self._told(self.run(s)) for s in statements]
        out = {"statements": parts, "elapsedMs": round((time.perf_counter() - began) * 1000, 1)}
        wrong = next((p for p in parts if "error" in p), None)
        if wrong:
            return {"error": wrong["error"]} | out
        for key in ("columns", "rows", "explain"):
            last = next((p for p in reversed(parts) if key in p), None)
            out |= {key: last[key]} if last else {}
        return out | ({"message": parts[-1]["message"]} if parts and "message" in parts[-1] else {})

    def _told(self, r: Result) -> dict:
        out: dict = {"type": r.kind} | ({"note": r.note} if r.note else {})
        if r.error:
            return out | {"error": r.error}
        if r.kind == "explain":
            return out | {"explain": {"text": (r.report or "").splitlines(), "tree": r.plan.tree() if r.plan else None}}
        if r.frame is None:
            return out | {"message": r.kind.replace("_", " ") + (f": {r.affected} rows" if r.affected is not None else "")}
        return out | {"columns": r.frame.columns, "rows": [row.asDict(recursive=True) for row in r.frame.collect()]}

    def described(self, name: str) -> dict:
        """Columns, layout, indexes and what is known of the rows of a table."""
        t = self._table(name)
        return {"name": t.name, "columns": [{k: c[k] for k in ("name", "type", "size", "key", "required")} for c in t.columns if c["name"] != RID], "layout": t.layout, "indexes": {n: {k: i[k] for k in ("column", "method", "options")} for n, i in t.indexes.items()}, "rows": t.rows, "files": t.parts, "version": t.version}

    def described_all(self) -> list[dict]:
        return [self.described(n) for n in self.tables.names()]

    def index_report(self, name: str) -> DataFrame:
        """What an index holds: rows of each cell, vectors and links of each shard, or terms and postings of each bucket."""
        table = next((t for t in self.tables.values() if name in t.indexes), None)
        if table is None or "path" not in table.indexes[name]:
            raise SemanticError(f"there is no stored index {name}")
        index = self._fresh(table, table.indexes[name])
        held = self.spark.read.parquet(index["path"])
        if index["method"] == "IVF":
            return held.groupBy("cell").agg(F.count("*").alias("rows"))
        if index["method"] == "HNSW":
            return held.select("shard", (F.length("ids") / 8).cast("long").alias("rows"), (F.length("links") / 4).cast("long").alias("links"))
        return held.groupBy("bucket").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.min("term").alias("first"), F.max("term").alias("last"))

    def layout_report(self, name: str) -> DataFrame:
        """``file, rows, least, greatest`` of the column that a managed table is laid out by."""
        table = self._managed(name)
        if not table.parts:
            return self.spark.createDataFrame([], "file string, rows long, least string, greatest string")
        key = F.col(f"`{table.ordered_by}`")
        read = self.spark.read.schema(_schema(table.columns)).parquet(*table.parts).select(key.alias("k"), F.col("_metadata.file_path").alias("file"))
        return read.groupBy("file").agg(F.count("*").alias("rows"), F.min("k").cast("string").alias("least"), F.max("k").cast("string").alias("greatest"))

    def reset(self) -> list[str]:
        """Drop every managed table, its files too; the names of those that went."""
        names = sorted(n for n, t in self.tables.items() if t.managed)
        for n in names:
            self.locks.acquire(self, n, "PX")
        for n in names:
            self._forget(self.tables.pop(n))
        self.locks.release(self)
        return names

    def save(self, path: str) -> None:
        """Write what is known of the managed tables to a new folder; their rows stay where they are.

        Locks hold between engines that share them only: one driver at a time changes a warehouse.
        """
        known = [{k: getattr(t, k) for k in SAVED} for t in self.tables.values() if t.managed]
        self.spark.sql("select 1").select(F.lit(json.dumps({"warehouse": self.warehouse, "tables": known}, default=str)).alias("value")).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Engine:
        """An engine with the tables that ``save`` has written to ``path``."""
        saved = json.loads(spark.read.text(path).first()["value"])
        engine = cls(spark, saved["warehouse"], **options)
        for t in saved["tables"]:
            engine.tables[t["name"]] = table = Table(frame=None, managed=True, **t)
            engine._opened(table)
        return engine

    def _opened(self, table: Table) -> None:
        schema = _schema(table.columns)
        table.frame = self.spark.read.schema(schema).parquet(*table.parts) if table.parts else self.spark.createDataFrame([], schema)

    # queries
    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise SemanticError(f"there is no table {name}")
        return self.tables[name]

    def _do_select(self, s: dict) -> Result:
        return Result("select", self._select(s))

    def _select(self, s: dict) -> DataFrame:
        scope = Scope(self)
        frame = None
        for source in s["sources"]:
            table = self._table(source["table"])
            if source["alias"] in scope.owners:
                raise SemanticError(f"the alias {source['alias']} stands twice")
            part = self._counted(f"scan {source['alias']}", table.frame.toDF(*[f"{source['alias']}.{c}" for c in table.frame.columns]))
            if frame is None:
                scope.add(source["alias"], table)
                frame = part
                continue
            before = set(scope.owners)
            scope.add(source["alias"], table)
            (a, ka), (b, kb) = scope.find(source["left"]), scope.find(source["right"])
            sides = {a.split(".")[0], b.split(".")[0]}
            if source["alias"] not in sides or not sides & before:
                raise SemanticError("ON links the new table with an earlier one")
            scope.comparable(ka, kb)
            frame = self._counted(f"join {source['alias']}", frame.join(part, F.col(f"`{a}`") == F.col(f"`{b}`"), "inner"))
        parts = s["where"]["parts"] if s["where"] and s["where"]["is"] == "and" else [s["where"]] if s["where"] else []
        special = [p for p in parts if p["is"] in ("match", "similar")]
        plain = [p for p in parts if p["is"] not in ("match", "similar")]
        if len(special) > 1 or special and (len(s["sources"]) > 1 or s["sources"][0]["aliased"]):
            raise SemanticError("one MATCH or SIMILAR_TO, over one table without an alias")
        if s["using"] and not special:
            raise SemanticError("USING needs MATCH or SIMILAR_TO")
        for p in plain:
            frame = frame.where(scope.predicate(p))
        frame = self._counted("filter", frame)
        scored = None
        if special:
            frame, scored = self._ranked(s, special[0], frame, scope)
        items = s["items"]
        scores = [i for i in items if i["item"] == "score"]
        if scores and (not scored or scores[0]["function"] != scored):
            raise SemanticError(f"{scores[0]['function']}() needs its search")
        dotted = len(s["sources"]) > 1 or any(x["aliased"] for x in s["sources"]) or any("." in str(i.get("column")) for i in items) or "." in str(s["group"])
        shown = lambda full: full if dotted else full.split(".", 1)[1]
        if s["group"] or any(i["item"] == "aggregate" for i in items):
            return self._grouped(s, frame, scope, shown)
        if items[0]["item"] == "star":
            chosen = [(f"{a}.{c['name']}", shown(f"{a}.{c['name']}")) for a, t in scope.owners.items() for c in t.columns if c["type"] != "VECTOR" and c["name"] != RID]
        else:
            chosen = [(full := scope.find(i["column"], hide=True)[0], shown(full)) for i in items if i["item"] == "column"]
        chosen += [("_score", i["alias"]) for i in scores]
        if len({o for _, o in chosen}) < len(chosen) or {i["alias"] for i in scores} & {c["name"] for t in scope.owners.values() for c in t.columns}:
            raise SemanticError("an output column stands twice")
        if s["order"]:
            if s["order"]["expr"] == "column" and s["order"]["column"] in [i["alias"] for i in scores]:
                key = F.col("_score")
            else:
                key = scope.value(s["order"])[0]
            frame = frame.orderBy(*self._order(key, s["desc"], scope, chosen))
        elif special:
            frame = frame.orderBy(F.desc("_score"), *self._ties(scope, chosen))
        if s["limit"] is not None:
            frame = frame.limit(s["limit"])
        return frame.select(*[F.col(f"`{c}`").alias(o) for c, o in chosen])

    def _counted(self, label: str, frame: DataFrame) -> DataFrame:
        """The frame, its rows counted on the way when EXPLAIN ANALYZE runs it."""
        if self.counting is None:
            return frame
        self.counting[label] = Observation(label)
        return frame.observe(self.counting[label], F.count(F.lit(1)).alias("rows"))

    def _ties(self, scope: Scope, chosen: list[tuple[str, str]]) -> list[Column]:
        """What decides between equal keys, so that LIMIT cuts alike however the files are split.

        Rows go by their serial number, in attached frames by their first column and then by what
        is shown of them: numbers as they are, all else by a hash, as sort keys may reach the driver.
        """
        out, last = [], []
        for a, t in scope.owners.items():
            if RID in t.frame.columns:
                out.append(F.col(f"`{a}.{RID}`"))
                continue
            data = {f"{a}.{f.name}": f.dataType for f in t.frame.schema if not any(w in f.dataType.simpleString() for w in ("map<", "variant"))}
            first = f"{a}.{t.columns[0]['name']}"
            out += [F.col(f"`{first}`")] if first in data else []
            last += [F.col(f"`{c}`") if isinstance(data[c], T.NumericType) else F.xxhash64(f"`{c}`") for c, _ in chosen if c in data and c != first]
        return out + last

    def _order(self, key: Column, desc: bool, scope: Scope, chosen: list[tuple[str, str]]) -> list[Column]:
        return [key.desc_nulls_first() if desc else key.asc_nulls_last(), *self._ties(scope, chosen)]

    def _ranked(self, s: dict, p: dict, frame: DataFrame, scope: Scope) -> tuple[DataFrame, str]:
        alias, table = next(iter(scope.owners.items()))
        first = f"{alias}.{RID}" if RID in table.frame.columns else f"{alias}.{table.columns[0]['name']}"
        options = s["options"]
        if p["is"] == "match":
            full, column = scope.find(p["column"])
            method = s["using"] or "BM25"
            if method not in ("BM25", "TF_IDF") or options and method != "BM25" or set(options) - {"K1", "B"}:
                raise SemanticError("MATCH takes USING TF_IDF or BM25, and K1 and B with BM25")
            if column["type"] not in ("TEXT", "VARCHAR") or not 0 <= options.get("B", 0.75) <= 1:
                raise SemanticError("MATCH takes a text column, and B from 0 to 1")
            k1, b = options.get("K1", 1.2), options.get("B", 0.75)
            index = next((i for i in table.indexes.values() if i["method"] == "FULLTEXT" and i["column"] == column["name"]), None)
            if index is not None:
                hits = text_index.search_text_index(self.spark, text_index.TextIndex(**self._fresh(table, index)["known"]), p["query"], method, k1, b, **self.analysis)
            else:
                whole = table.frame.toDF(*[f"{alias}.{c}" for c in table.frame.columns]).select(F.col(f"`{first}`").alias("_d"), F.col(f"`{full}`").alias("_t"))
                hits = search.match(whole, p["query"], "_d", "_t", method, k1, b, **self.analysis)
            return frame.join(hits.select(F.col("doc").alias("_doc"), F.col("score").alias("_score")), F.col(f"`{first}`") == F.col("_doc")).drop("_doc"), "SCORE"
        vectors = [c for c in table.columns if c["type"] == "VECTOR"]
        if len(vectors) != 1:
            raise SemanticError("SIMILAR_TO takes a table with one vector column")
        method, metric = s["using"], options.get("METRIC")
        if method not in (None, "SEQ", "IVF", "HNSW") or "PROBES" in options and method != "IVF" or "EF_SEARCH" in options and method != "HNSW" or metric not in (None, "cosine", "euclidean", "dot"):
            raise SemanticError("PROBES goes with IVF and EF_SEARCH with HNSW")
        asked = self._asked(table, p["query"], vectors[0]["size"])
        names = {"id_col": "_i", "vector_col": "_v"}
        aimed = frame.withColumn("_i", F.col(f"`{first}`")).withColumn("_v", F.col(f"`{alias}.{vectors[0]['name']}`"))
        chosen = self._vector_index(table, vectors[0]["name"], method, metric if method else "cosine")
        if method in ("IVF", "HNSW") and chosen is None:
            self.note = f"there is no {method} index" + (f" with metric {metric}" if metric else "") + "; all rows are searched"
        if chosen is None:
            found = search.nearest(aimed, asked, p["k"], metric or "cosine", **names)
        else:
            found = self._by_index(table, chosen, aimed, asked, p["k"], options)
        return found.withColumnRenamed("score", "_score"), "SIMILARITY_SCORE"

    def _asked(self, table: Table, query, size: int | None) -> list[float]:
        """The vector of a query: as written, or of a file."""
        if isinstance(query, str):
            if self.vectorizer is None:
                raise SemanticError("no extractor is set up for a search by file; use SIMILAR_TO(VECTOR(...), k=...)")
            try:
                query = {"vector": [float(x) for x in self.vectorizer(table.name, query)]}
            except (ValueError, OSError) as e:
                raise SemanticError(str(e)) from None
        if not isinstance(query, dict) or "vector" not in query:
            raise SemanticError("SIMILAR_TO takes a vector or the path of a file")
        vector = query["vector"]
        if size and size != len(vector):
            raise SemanticError(f"the vector has {len(vector)} components, the column {size}")
        if not all(abs(x) <= FLOAT_MOST for x in vector):
            raise SemanticError("the vector exceeds the range of FLOAT")
        return vector

    def _vector_index(self, table: Table, column: str, method: str | None, metric: str | None) -> dict | None:
        """The index to search: the first that fits what is asked; without USING the one that
        reads fewest rows, if it reads fewer than all."""
        if method == "SEQ":
            return None
        fits = [i for _, i in sorted(table.indexes.items()) if i["column"] == column and i["method"] in ("IVF", "HNSW") and method in (None, i["method"]) and metric in (None, i["options"].get("METRIC", "cosine"))]
        if not fits:
            return None
        fits = [self._fresh(table, i) for i in (fits[:1] if method else fits)]
        return fits[0] if method else min([i for i in fits if i["reads"] < (table.rows or 0)], key=lambda i: i["reads"], default=None)

    def _by_index(self, table: Table, index: dict, aimed: DataFrame, asked: list[float], k: int, options: dict) -> DataFrame:
        """Rows of ``aimed`` (filtered already) that the index finds; it looks further until ``k`` pass."""
        metric, path = index["options"].get("METRIC", "cosine"), index["path"]
        n = table.rows or 0
        if index["method"] == "IVF":
            centres = np.array(index["centres"])
            if "PROBES" in options and not 1 <= options["PROBES"] <= len(centres):
                raise SemanticError(f"PROBES is from 1 to {len(centres)}")
            probes = options.get("PROBES", index["probes"])
            cells = self.spark.read.parquet(path)
            while True:
                near = np.flatnonzero(search.probed_cells(centres, [asked], probes, metric)[0])
                part = cells.where(F.col("cell").isin(*map(int, near))).select(F.col("rid").alias("_r"))
                found = search.nearest(aimed.join(part, F.col("_i") == F.col("_r"), "left_semi"), asked, k, metric, "_i", "_v")
                if probes >= len(centres) or found.count() >= k:
                    return found
                probes = min(len(centres), probes * 4)
        ef = max(options.get("EF_SEARCH", search.EF), k)
        query = self.spark.createDataFrame([(0, asked)], "id long, v array<double>")
        while True:
            ids = search.graph_many(self.spark.read.parquet(path), query, ef, metric, ef, "id", "v").select(F.col("id").alias("_r"))
            found = search.nearest(aimed.join(F.broadcast(ids), F.col("_i") == F.col("_r"), "left_semi"), asked, k, metric, "_i", "_v")
            if ef >= n or found.count() >= k:
                return found
            ef = min(n, ef * 4)

    def _fresh(self, table: Table, index: dict) -> dict:
        """The index over the table as it is: made now if it is missing or older than a change."""
        if index.get("version") == table.version and "path" in index:
            return index
        old, path = index.get("path"), f"{table.folder}/index-{uuid.uuid4().hex[:12]}"
        metric = index["options"].get("METRIC", "cosine")
        rows = table.frame.select(F.col(RID).alias("rid"), F.col(f"`{index['column']}`").alias("v"))
        if index["method"] == "FULLTEXT":
            index["known"] = text_index.build_text_index(rows, "rid", "v", path, **self.analysis).known()
        elif index["method"] == "IVF":
            placed, centres = search.ivf_index(rows, index["options"].get("LISTS"), metric, "rid", "v")
            placed.select("rid", "cell").repartition("cell").write.partitionBy("cell").parquet(path)
            index["probes"] = search.calibrated_probes(rows, placed, centres, metric, id_col="rid", vector_col="v")
            index["centres"] = centres.tolist()
            index["reads"] = len(centres) + (table.rows or 0) * index["probes"] / len(centres)
        elif index["method"] == "HNSW":
            search.graph_index(rows, "rid", "v", metric, index["options"].get("M", search.LINKS)).write.parquet(path)
            index["reads"] = search.EF * search.LINKS * max(1, (table.rows or 0) / search.SHARD)
        index |= {"path": path, "version": table.version}
        if old:
            self._emptied(old)
        return index

    def _emptied(self, path: str) -> None:
        """Delete the files of a folder through Spark, whatever the store."""
        self.spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)

    def _forget(self, table: Table) -> None:
        for path in [*table.past, *table.parts, *[i["path"] for i in table.indexes.values() if "path" in i]]:
            self._emptied(path)

    def _grouped(self, s: dict, frame: DataFrame, scope: Scope, shown) -> DataFrame:
        items = [{"item": "column", "column": s["group"]}, {"item": "aggregate", "function": "COUNT", "column": "*"}] if s["items"][0]["item"] == "star" else s["items"]
        group = scope.find(s["group"])[0] if s["group"] else None
        chosen, aggregates = [], {}
        for i in items:
            if i["item"] == "score":
                raise SemanticError("scores and aggregates don't go together")
            if i["item"] == "column":
                if scope.find(i["column"])[0] != group:
                    raise SemanticError(f"{i['column']} is neither grouped nor aggregated")
                chosen.append(("_group", shown(group)))
                continue
            name = "conteo" if i["column"] == "*" else f"{i['function'].lower()}_{i['column']}"
            if name in aggregates:
                raise SemanticError(f"{name} stands twice")
            aggregates[name] = scope.aggregate(i)
            chosen.append((name, name))
        aggregates = aggregates or {"conteo": F.count("*")}
        made = [v.alias(k) for k, v in aggregates.items()]
        out = frame.groupBy(F.col(f"`{group}`").alias("_group")).agg(*made) if group else frame.agg(*made)
        if s["order"]:
            if s["order"]["expr"] != "column":
                raise SemanticError("no distance after GROUP BY")
            name = s["order"]["column"]
            key = name if name in aggregates else "_group" if group and scope.find(name)[0] == group else None
            if key is None or key not in [c for c, _ in chosen]:
                raise SemanticError(f"{name} isn't among the output columns")
            column = F.col(f"`{key}`")
            out = out.orderBy(column.desc_nulls_first() if s["desc"] else column.asc_nulls_last())
        if s["limit"] is not None:
            out = out.limit(s["limit"])
        return out.select(*[F.col(f"`{c}`").alias(o) for c, o in chosen])

    # definitions and changes
    def _do_create_table(self, s: dict) -> Result:
        if s["table"] in self.tables:
            raise SemanticError(f"{s['table']} is there already")
        names = [c["name"] for c in s["columns"]]
        if len(set(names)) < len(names):
            raise SemanticError("a column stands twice")
        if any(c["key"] and c["type"] in ("POINT", "TEXT", "VECTOR") for c in s["columns"]):
            raise SemanticError("a key is a number, a VARCHAR or a DATE")
        if not self.warehouse:
            raise SemanticError("tables need a warehouse folder")
        scalars = [c["name"] for c in s["columns"] if c["type"] not in ("POINT", "TEXT", "VECTOR")]
        if not scalars:
            raise SemanticError("a table takes a scalar column to be laid out by")
        if sum(BYTES.get(c["type"], 4 * (c["size"] or 8)) for c in s["columns"]) + RECORD_OWN > RECORD_MOST:
            raise SemanticError(f"a record has {RECORD_MOST} bytes at most")
        ordered_by = next((c["name"] for c in s["columns"] if c["key"]), scalars[0])
        table = Table(s["table"], s["columns"], None, True, 0, s["using"] or "HASH", ordered_by=ordered_by, folder=f"{self.warehouse}/{s['table']}-{uuid.uuid4().hex[:12]}", rows=0)
        self._opened(table)
        self.tables[s["table"]] = table
        return Result("create_table", affected=0)

    def _do_drop_table(self, s: dict) -> Result:
        if s["name"] not in self.tables and not s["if_exists"]:
            raise SemanticError(f"there is no table {s['name']}")
        table = self.tables.pop(s["name"], None)
        if table is not None and table.managed:
            self._forget(table)
        return Result("drop_table", affected=0)

    def _do_create_index(self, s: dict) -> Result:
        table = self._table(s["table"])
        column = table.column(s["column"])
        if any(s["name"] in t.indexes for t in self.tables.values()):
            raise SemanticError(f"the index {s['name']} is there already")
        fits = {"HASH": column["type"] not in ("POINT", "TEXT", "VECTOR"), "BPLUS": column["type"] not in ("POINT", "TEXT", "VECTOR"), "FULLTEXT": column["type"] == "TEXT", "IVF": column["type"] == "VECTOR", "HNSW": column["type"] == "VECTOR"}
        if not fits.get(s["method"]):
            raise SemanticError(f"{s['method']} doesn't go with {column['type']}")
        if any(i["column"] == s["column"] and i["method"] == s["method"] and i["options"].get("METRIC") == s["options"].get("METRIC") for i in table.indexes.values()):
            raise SemanticError("such an index is there already")
        if s["method"] == "FULLTEXT" and any(i["method"] == "FULLTEXT" and i["column"] == s["column"] for i in table.indexes.values()):
            raise SemanticError("such an index is there already")
        index = {"column": s["column"], "method": s["method"], "options": s["options"]}
        if s["method"] in ("FULLTEXT", "IVF", "HNSW"):
            self._managed(s["table"])
            self._fresh(table, index)
        table.indexes[s["name"]] = index
        return Result("create_index", affected=0)

    def _do_drop_index(self, s: dict) -> Result:
        owner = next((t for t in self.tables.values() if s["name"] in t.indexes), None)
        if owner is None and not s["if_exists"]:
            raise SemanticError(f"there is no index {s['name']}")
        if owner and "path" in (gone := owner.indexes.pop(s["name"])):
            self._emptied(gone["path"])
        return Result("drop_index", affected=0)

    def _write(self, table: Table, frame: DataFrame, rows: int, anew: bool = True) -> None:
        """Write a folder: all rows of the table (``anew``), or rows to be added."""
        self.locks.acquire(self, table.name, "PX")
        path = f"{table.folder}/v{table.version + 1}"
        writer = self._laid_out(table, frame).write.mode("overwrite")
        for c in table.columns:
            if c["name"] == table.ordered_by and table.layout == "HASH" or any(i["method"] == "HASH" and i["column"] == c["name"] for i in table.indexes.values()):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c['name']}", "true")
        writer.parquet(path)
        table.version += 1
        if anew:  # readers of the state before keep its folders, those of older ones don't
            for old in table.past:
                self._emptied(old)
            table.past = table.parts
        table.parts = [path] if anew else [*table.parts, path]
        table.rows = rows
        self._opened(table)

    def _laid_out(self, table: Table, frame: DataFrame) -> DataFrame:
        """Rows in ranges of the key (ordered layouts), else of the tiles of their points.

        Ranges and row groups then hold few keys or tiles each, and scans skip the others.
        """
        key = table.ordered_by
        point = next((c["name"] for c in table.columns if c["type"] == "POINT"), None)
        if table.layout in ("BPLUS", "BPLUS_CLUSTERED"):
            order = [F.col(f"`{key}`")]
        elif point:
            order = [F.floor(F.col(f"`{point}`.{x}") / TILE) for x in ("lat", "lon")]
        else:
            return frame
        return frame.repartitionByRange(*order).sortWithinPartitions(*order)

    def _changed(self, table: Table, n: int) -> None:
        """Count changes; after many of them statistics are made anew."""
        table.changes += n
        if table.changes > CHANGES + CHANGED_SHARE * (table.statistics.get("", {}).get("rows", 0) if table.analyzed else 0):
            self._do_analyze({"table": table.name})

    def _managed(self, name: str) -> Table:
        table = self._table(name)
        if not table.managed:
            raise SemanticError(f"{name} is attached for reading")
        return table

    def _do_insert(self, s: dict) -> Result:
        table = self._managed(s["table"])
        names = s["columns"] or [c["name"] for c in table.columns]
        if len(set(names)) < len(names):
            raise SemanticError("a column stands twice")
        for n in names:
            table.column(n)
        rows = []
        for r in s["rows"]:
            if len(r) != len(names):
                raise SemanticError("another number of values than of columns")
            given = dict(zip(names, r, strict=True))
            rows.append([self.checked(c, given.get(c["name"])) for c in table.columns])
        key = next((i for i, c in enumerate(table.columns) if c["key"]), None)
        if key is not None:
            keys = [r[key] for r in rows]
            if len(set(keys)) < len(keys) or not table.frame.where(F.col(table.columns[key]["name"]).isin(keys)).isEmpty():
                raise SemanticError("the key is there already")
        last = table.last_rid
        new = self.spark.createDataFrame([(*r, last + 1 + i) for i, r in enumerate(rows)], _schema(table.columns))
        self.add_rows(table, new, len(rows))
        return Result("insert", affected=len(rows))

    def add_rows(self, table: Table, new: DataFrame, n: int) -> None:
        """Append rows that have been checked and numbered; many small folders become one."""
        table.last_rid += n
        anew = len(table.parts) >= FOLDERS
        self._write(table, table.frame.unionByName(new) if anew else new, (table.rows or 0) + n, anew)
        self._changed(table, n)

    def load_rows(self, name: str, frame: DataFrame, order: str) -> int:
        """Append a frame's rows to a managed table, in the order of a column of whole numbers.

        Columns go by name and type; values are taken as they are.
        """
        table = self._managed(name)
        typed = numbered(frame, order, RID).select(*[F.col(f"`{c['name']}`").cast(TYPES[c["type"]]).alias(c["name"]) for c in table.columns], (F.col(RID) + table.last_rid).cast("long").alias(RID))
        n = frame.count()
        self.add_rows(table, typed, n)
        return n

    def replace_vectors(self, table: Table, column: str, new: DataFrame) -> int:
        """Give rows (by number) other vectors; ``new`` holds the row number and ``_new``."""
        n = new.count()
        old = table.frame.columns
        joined = table.frame.join(new, RID, "left")
        self._write(table, joined.select(*[(F.coalesce("_new", F.col(f"`{c}`")) if c == column else F.col(f"`{c}`")).alias(c) for c in old]), table.rows or 0)
        self._changed(table, n)
        return n

    def checked(self, c: dict, v):
        """A value as the column stores it; SemanticError if it doesn't fit."""
        if v is None:
            if c["required"]:
                raise SemanticError(f"{c['name']} is not null")
            return None
        try:
            if c["type"] == "INT":
                n = int(v)
                if isinstance(v, float) and v != n or not -(2**31) <= n < 2**31:
                    raise ValueError
                return n
            if c["type"] == "FLOAT":
                x = float(v)
                if not math.isfinite(x) or abs(x) > FLOAT_MOST:
                    raise ValueError
                return x
            if c["type"] in ("POINT", "VECTOR"):
                inner = v[c["type"].lower()]
                if c["type"] == "VECTOR" and (len(inner) != c["size"] or not all(abs(x) <= FLOAT_MOST for x in inner)):
                    raise ValueError
                return inner
            if not isinstance(v, str) or c["type"] == "VARCHAR" and c["size"] and len(v) > c["size"]:
                raise ValueError
            if c["type"] == "DATE":
                datetime.date.fromisoformat(v)
            return v
        except (ValueError, TypeError, KeyError, OverflowError):
            raise SemanticError(f"{v!r} doesn't fit {c['name']} {c['type']}") from None

    def _hit(self, table: Table, where: dict | None) -> Column:
        scope = Scope(self)
        scope.add(table.name, table)
        return F.coalesce(scope.predicate(where), F.lit(False)) if where else F.lit(True)

    def _do_delete(self, s: dict) -> Result:
        table = self._managed(s["table"])
        aliased = table.frame.toDF(*[f"{table.name}.{c}" for c in table.frame.columns])
        marked = aliased.withColumn("_hit", self._hit(table, s["where"]))
        n = marked.where("_hit").count()
        if n:
            self._write(table, marked.where("not _hit").drop("_hit").toDF(*table.frame.columns), (table.rows or 0) - n)
            self._changed(table, n)
        return Result("delete", affected=n)

    def _do_update(self, s: dict) -> Result:
        table = self._managed(s["table"])
        aliased = table.frame.toDF(*[f"{table.name}.{c}" for c in table.frame.columns])
        marked = aliased.withColumn("_hit", self._hit(table, s["where"]))
        n = marked.where("_hit").count()
        if not n:
            return Result("update", affected=0)
        new = {name: self.checked(table.column(name), v) for name, v in s["set"].items()}
        for name, v in new.items():
            if table.column(name)["key"] and (n > 1 or not marked.where(~F.col("_hit") & (F.col(f"`{table.name}.{name}`") == F.lit(v))).isEmpty()):
                raise SemanticError("the key is there already")

        def changed(c: str) -> Column:
            old = F.col(f"`{table.name}.{c}`")
            if c not in new:
                return old.alias(c)
            kind, v = TYPES[table.column(c)["type"]], new[c]
            value = F.lit(None) if v is None else F.struct(*map(F.lit, v)) if isinstance(v, tuple) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
            return F.when(F.col("_hit"), value.cast(kind)).otherwise(old).alias(c)

        self._write(table, marked.select(*[changed(c) for c in table.frame.columns]), table.rows or 0)
        self._changed(table, n)
        return Result("update", affected=n)

    def _do_analyze(self, s: dict) -> Result:
        table = self._table(s["table"])
        frame = statistics(table.frame, [(c["name"], c["type"]) for c in table.columns if c["name"] != RID])
        table.statistics = {r["column"]: r.asDict() for r in frame.collect()}
        if not table.managed:
            table.rows = table.frame.count()
        table.statistics[""] = {"column": "", "rows": table.rows}
        table.changes, table.analyzed = 0, True
        return Result("analyze", frame)

    def _do_explain(self, s: dict) -> Result:
        inner = s["statement"]
        began = time.perf_counter()
        if inner["kind"] != "select":
            table = self._table(inner["table"])
            found = len(inner["rows"]) if inner["kind"] == "insert" else round(expected(table) * share(inner["where"], table))
            below = Node("Values", rows=found) if inner["kind"] == "insert" else Node("Seq Scan", table.name, rows=found)
            plan = Node("Modify", table.name, details=[f"Operation: {inner['kind']}"], rows=found, children=[below])
            done = getattr(self, f"_do_{inner['kind']}")(inner) if s["analyze"] else None
            if done:
                plan.actual = done.affected
            return Result("explain", plan=plan, report=self._report(plan, s["analyze"], began))
        self.counting = {} if s["analyze"] else None
        try:
            frame = self._select(inner)
            plan = self._plan(inner)
            counts = {}
            if s["analyze"]:
                plan.actual = frame.count()
                counts = {label: o.get["rows"] for label, o in self.counting.items()}
        finally:
            self.counting = None
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            frame.explain("formatted")
        return Result("explain", plan=plan.filled(counts), report=self._report(plan, s["analyze"], began) + "\n" + text.getvalue())

    def _report(self, plan: Node, ran: bool, began: float) -> str:
        return "\n".join([*plan.lines(), f"{'Execution' if ran else 'Planning'} Time: {(time.perf_counter() - began) * 1000:.3f} ms"])

    def _plan(self, s: dict) -> Node:
        """The tree of a SELECT that has been checked."""
        parts = s["where"]["parts"] if s["where"] and s["where"]["is"] == "and" else [s["where"]] if s["where"] else []
        special = next((p for p in parts if p["is"] in ("match", "similar")), None)
        plain = [p for p in parts if p is not special]
        node = None
        for source in s["sources"]:
            table, alias = self._table(source["table"]), source["alias"]
            scan = self._scan(table, alias, plain, special, s)
            if node is None:
                node = scan
                continue
            node = Node("Hash Join", details=[f"On: {source['left']} = {source['right']}"], rows=max(node.rows, scan.rows), children=[node, scan], label=f"join {alias}")
        if plain:
            table = self._table(s["sources"][0]["table"])
            kept = share({"is": "and", "parts": plain}, table)
            node = Node("Filter", details=[f"{len(plain)} conditions"], rows=max(1, round(node.rows * kept)), children=[node], label="filter")
        if s["group"] or any(i["item"] == "aggregate" for i in s["items"]):
            groups = self._table(s["sources"][0]["table"]).statistics.get(str(s["group"]).split(".")[-1], {}).get("n_distinct", max(1, node.rows // 10))
            node = Node("HashAggregate", details=[f"Group: {s['group']}"] if s["group"] else [], rows=groups if s["group"] else 1, children=[node])
        if s["order"] or special:
            node = Node("Top-N Sort" if s["limit"] is not None else "Sort", rows=node.rows, children=[node])
        if s["limit"] is not None:
            node = Node("Limit", details=[f"Rows: {s['limit']}"], rows=min(node.rows, s["limit"]), children=[node])
        return node

    def _scan(self, table: Table, alias: str, plain: list[dict], special: dict | None, s: dict) -> Node:
        """How a table is read: by the index that a condition fits, or whole."""
        rows, label = expected(table), f"scan {alias}"
        if special and special["is"] == "match":
            column = special["column"].split(".")[-1]
            index = next((n for n, i in table.indexes.items() if i["method"] == "FULLTEXT" and i["column"] == column), None)
            return Node("Text Index Scan" if index else "Text Scan", table.name, index, [f"Match: {column} {s['using'] or 'BM25'}"], max(1, rows // 10), label=label)
        if special:
            column = next(c["name"] for c in table.columns if c["type"] == "VECTOR")
            chosen = self._vector_index(table, column, s["using"], s["options"].get("METRIC") if s["using"] else "cosine")
            name = next((n for n, i in table.indexes.items() if i is chosen), None)
            details = [f"Similarity: {column} k={special['k']}"] + ([self.note] if self.note else []) + (["Looks further until k rows pass the filter"] if chosen and plain else [])
            return Node("Vector Index Scan" if chosen else "Vector Seq Scan", table.name, name, details, min(rows, special["k"]), label=label)
        for p in plain:
            left = p.get("left", {})
            column = str(left.get("column") or p.get("column") or left.get("a", {}).get("column", "")).split(".")[-1]
            known = next((c for c in table.columns if c["name"] == column), None)
            if known is None or "." in str(left.get("column")) and left["column"].split(".")[0] != alias:
                continue
            if p["is"] == "inside" or left.get("expr") == "distance" and known["type"] == "POINT" and p.get("op") in ("<", "<="):
                return Node("Spatial Index Scan", table.name, None, [f"Tiles of {column}"], max(1, round(rows * share(p, table))), label=label)
            sorted_by = column == table.ordered_by and table.layout in ("BPLUS", "BPLUS_CLUSTERED")
            index = next((n for n, i in table.indexes.items() if i["column"] == column and i["method"] in ("HASH", "BPLUS")), None)
            equal = p["is"] == "compare" and p["op"] == "=" and "value" in p
            ranged = p["is"] == "between" or p["is"] == "compare" and p["op"] in ("<", "<=", ">", ">=") and "value" in p
            if equal and (column == table.ordered_by or index) or ranged and sorted_by:
                return Node("Index Scan", table.name, index or f"{table.name}_key", [f"Condition on {column}"], max(1, round(rows * share(p, table))), label=label)
        return Node("Seq Scan", table.name, rows=rows, label=label)

    def _do_begin(self, s: dict) -> Result:
        if self.open:
            raise SemanticError("a transaction is open")
        self.open = True
        return Result("begin")

    def _do_end(self, s: dict) -> Result:
        if not self.open:
            raise SemanticError("no transaction is open")
        self.open = False
        return Result("end")


class Scope:
    """The tables of a statement, and the meaning of names and predicates over them."""

    def __init__(self, engine: Engine):
        self.engine, self.owners = engine, {}

    def add(self, alias: str, table: Table) -> None:
        self.owners[alias] = table

    def find(self, name: str, hide: bool = False) -> tuple[str, dict]:
        if "." in name:
            alias, _, bare = name.partition(".")
            if alias not in self.owners:
                raise SemanticError(f"there is no table {alias}")
            found = [(alias, self.owners[alias].column(bare))]
        else:
            found = [(a, c) for a, t in self.owners.items() for c in t.columns if c["name"] == name]
        if not found or hide and found[0][1]["type"] == "VECTOR":
            raise SemanticError(f"there is no column {name}")
        if len(found) > 1:
            raise SemanticError(f"{name} is ambiguous")
        return f"{found[0][0]}.{found[0][1]['name']}", found[0][1]

    def comparable(self, a: dict, b: dict) -> None:
        if a["type"] != b["type"] and not {a["type"], b["type"]} <= set(NUMBERS) and not {a["type"], b["type"]} <= {"VARCHAR", "TEXT"}:
            raise SemanticError(f"{a['type']} and {b['type']} don't compare")

    def _place(self, p: dict) -> tuple[Column, Column]:
        if "point" in p:
            return F.lit(p["point"][0]), F.lit(p["point"][1])
        if p["column"] in self.engine.parameters:
            lat, lon = self.engine.parameters[p["column"]]
            return F.lit(float(lat)), F.lit(float(lon))
        full, c = self.find(p["column"])
        if c["type"] != "POINT":
            raise SemanticError(f"{p['column']} is no point")
        return F.col(f"`{full}`").getField("lat"), F.col(f"`{full}`").getField("lon")

    def value(self, e: dict) -> tuple[Column, dict]:
        if e["expr"] == "distance":
            if e["metric"] not in ("haversine", "euclidean"):
                raise SemanticError(f"unknown metric {e['metric']}")
            return distance(*self._place(e["a"]), *self._place(e["b"]), e["metric"]), {"type": "FLOAT", "name": "distancia", "double": True, "size": None, "required": False}
        full, c = self.find(e["column"])
        return F.col(f"`{full}`"), c

    def literal(self, c: dict, v) -> Column:
        if v is None:
            raise SemanticError("a comparison with NULL says nothing")
        if c["type"] == "INT":
            try:
                x = float(v)
                n = int(v) if x == int(x) else x
            except (TypeError, ValueError, OverflowError):
                raise SemanticError(f"{v!r} is no number") from None
            return F.lit(n)
        checked = self.engine.checked({**c, "required": False, "size": None if c["type"] == "VARCHAR" else c["size"]}, v)
        if c["type"] == "POINT":
            return F.struct(F.lit(checked[0]).alias("lat"), F.lit(checked[1]).alias("lon"))
        if c["type"] == "FLOAT" and not c.get("double"):
            return F.lit(checked).cast("float")
        return F.lit(checked)

    def predicate(self, p: dict) -> Column:
        kind = p["is"]
        if kind in ("and", "or"):
            out = self.predicate(p["parts"][0])
            for q in p["parts"][1:]:
                out = out & self.predicate(q) if kind == "and" else out | self.predicate(q)
            return out
        if kind == "not":
            return ~self.predicate(p["part"])
        if kind in ("match", "similar"):
            raise SemanticError("MATCH and SIMILAR_TO stand alone or under AND, in SELECT")
        if kind == "inside":
            full, c = self.find(p["column"])
            if c["type"] != "POINT":
                raise SemanticError(f"{p['column']} is no point")
            try:
                point = F.col(f"`{full}`")
                return in_polygon(point.getField("lat"), point.getField("lon"), [v["point"] for v in p["polygon"]])
            except (ValueError, TypeError, KeyError) as e:
                raise SemanticError(str(e)) from None
        x, c = self.value(p["left"])
        flip = (lambda y: ~y) if p.get("not") else (lambda y: y)
        if kind == "null":
            return x.isNotNull() if p["not"] else x.isNull()
        if kind == "between":
            return flip(x.between(self.literal(c, p["low"]), self.literal(c, p["high"])))
        if kind == "in":
            known = [self.literal(c, v) for v in p["values"] if v is not None]
            found = x.isin(*known) if known else F.lit(False)
            return flip(found | F.lit(None).cast("boolean") if None in p["values"] else found)
        if kind == "like":
            if c["type"] not in STRINGS:
                raise SemanticError("LIKE takes strings")
            mark = next(ch for ch in map(chr, range(1, 32)) if ch not in p["pattern"])
            return flip(F.like(x, F.lit(p["pattern"]), F.lit(mark)))
        if "column" in p:
            full, d = self.find(p["column"])
            if "POINT" in (c["type"], d["type"]):
                raise SemanticError("points don't compare with columns")
            self.comparable(c, d)
            y = F.col(f"`{full}`")
        else:
            y = self.literal(c, p["value"])
        out = {"=": x == y, "!=": x != y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[p["op"]]
        if p["left"]["expr"] == "distance" and p["op"] in ("<", "<=") and p["left"]["metric"] == "haversine" and isinstance(p.get("value"), (int, float)):
            a, b = p["left"]["a"], p["left"]["b"]
            column, centre = (a, b) if "column" in a and a["column"] not in self.engine.parameters else (b, a)
            fixed = centre.get("point") or self.engine.parameters.get(centre.get("column"))
            if fixed and "column" in column:
                out = radius_box(*self._place(column), fixed, float(p["value"])) & out
        return out

    def aggregate(self, i: dict) -> Column:
        if i["column"] == "*":
            return F.count("*")
        full, c = self.find(i["column"])
        x = F.col(f"`{full}`")
        if i["function"] in ("SUM", "AVG") and c["type"] not in NUMBERS:
            raise SemanticError(f"{i['function']} takes numbers")
        if i["function"] == "SUM":  # rows without a value sum up to 0, no rows to null
            return F.when(F.count("*") > 0, F.coalesce(F.sum(x), F.lit(0)))
        return {"COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[i["function"]](x)


def statistics(frame: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """A row for each column: distinct values, least, greatest, share of nulls, mean length, box of points."""
    made, no = [], F.lit(None).cast("string")
    for n, kind in columns:
        x = F.col(f"`{n}`")
        text = x.cast("string") if kind not in ("POINT", "VECTOR") else F.to_json(F.array(x))
        low, high = (F.min(x).cast("string"), F.max(x).cast("string")) if kind not in ("POINT", "VECTOR") else (no, no)
        lat, lon = (x["lat"], x["lon"]) if kind == "POINT" else (F.lit(None).cast("double"),) * 2
        box = F.when(F.count(lat) > 0, F.array(F.min(lat), F.min(lon), F.max(lat), F.max(lon)))
        made.append(F.struct(F.lit(n).alias("column"), F.count_distinct(text).alias("n_distinct"), low.alias("least"), high.alias("greatest"), F.coalesce(F.avg(x.isNull().cast("double")), F.lit(0.0)).alias("null_fraction"), F.avg(F.length(text)).alias("mean_length"), box.alias("box")).alias(f"s_{n}"))
    return frame.agg(*made).select(F.explode(F.array(*[f"`s_{n}`" for n, _ in columns])).alias("s")).select("s.*")
