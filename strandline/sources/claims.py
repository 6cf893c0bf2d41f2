"""One-shot claims in shared storage: a chain of entries that many writers may extend, pre-registrations, and a hold-out that opens once.

A claim is a file that must not exist yet. On a shared file system it is created exclusively, which the file system decides, so of two
writers one is refused; a retry of the one that won is refused too, as it cannot be told from another. Entries are small and
written by the driver; what they speak of stays in DataFrames and is digested by the cluster.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "seq long, prev string, at string, kind string, body string, hash string"


def _local(path: str) -> str | None:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:/")) else None


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was created, with ``text`` in it; False if it was there already."""
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        draft = f"{own}.{os.getpid()}.{os.urandom(6).hex()}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, own)  # one name, one winner, and never half a text
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
    except Exception as e:  # of the gateway; the cause says why
        if "AlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """seq, prev, at, kind, body (JSON), hash of a chain, in no order; empty if there is none."""
    try:
        rows = spark.read.schema(ENTRY).json(f"{folder}/entry-*.json")
        rows.limit(1).count()
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTRY)


def _digest(entry: dict) -> str:
    return hashlib.sha256(json.dumps({k: entry[k] for k in ("seq", "prev", "at", "kind", "body")}, sort_keys=True).encode()).hexdigest()


def append(spark: SparkSession, folder: str, kind: str, body: dict, only_first: bool = False) -> dict | None:
    """The entry as written: its number, the hash of the one before, and its own. A writer that loses a number to another takes the next.

    only_first: None instead, if the chain has an entry of this kind already."""
    while True:
        known = entries(spark, folder)
        last = known.orderBy(F.desc("seq")).first()
        if only_first and known.where(F.col("kind") == kind).limit(1).count():
            return None
        entry = {"seq": last["seq"] + 1 if last else 0, "prev": last["hash"] if last else "", "at": datetime.now(timezone.utc).isoformat(), "kind": kind, "body": json.dumps(body, sort_keys=True)}
        entry["hash"] = _digest(entry)
        if claim(spark, f"{folder}/entry-{entry['seq']:09d}.json", json.dumps(entry)):
            return entry


def problems(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with a chain: entries that were changed, are missing or do not follow the one before."""
    found, before = [], ("", -1)
    for e in entries(spark, folder).orderBy("seq").toLocalIterator():
        if e["hash"] != _digest(e.asDict()):
            found.append(f"entry {e['seq']} was changed")
        if (e["prev"], e["seq"]) != (before[0], before[1] + 1):
            found.append(f"entry {e['seq']} does not follow entry {before[1]}")
        before = (e["hash"], e["seq"])
    return found


def variant(source: str) -> str:
    """A program's id: equal for texts that differ in comments, doc strings and layout alone."""
    tree = ast.parse(source)
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            node.body = body[1:] or [ast.Pass()]
    return hashlib.sha256(ast.unparse(tree).encode()).hexdigest()[:16]


def content(rows: DataFrame) -> dict:
    """An id of a table's rows whatever their order and partitions, and their number."""
    each = [*rows.columns, *[F.col(c).isNull() for c in rows.columns]]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("decimal(38,0)")).alias(k) for k, x in (("a", F.xxhash64(*each)), ("b", F.xxhash64(F.lit(1), *each)))]).first()
    return {"rows": one["n"], "data": hashlib.sha256(f"{one['n']}:{one['a']}:{one['b']}:{rows.schema.simpleString()}".encode()).hexdigest()[:32]}


def register(spark: SparkSession, folder: str, hypothesis: str, source: str | None = None, params: dict | None = None, trials: int | None = None) -> str:
    """The id of a hypothesis written down before it is tested; the program itself is not kept, only its id."""
    if not hypothesis.strip():
        raise ValueError("a hypothesis is a sentence: what is expected, and why")
    entry = append(spark, folder, "registration", {"hypothesis": hypothesis.strip(), "variant": variant(source) if source else None, "params": params or {}, "trials": trials})
    return f"reg-{entry['seq']}-{entry['hash'][:8]}"


def registration(spark: SparkSession, folder: str, reg_id: str, source: str, first_run: str | None = None) -> dict:
    """found, same_code, before (the first run, an ISO time), protects: whether a registration covers this program's result."""
    seq, _, head = reg_id.removeprefix("reg-").partition("-")
    entry = entries(spark, folder).where((F.col("seq") == int(seq)) & F.col("hash").startswith(head)).first()
    if entry is None or problems(spark, folder):
        return {"found": entry is not None, "same_code": False, "before": False, "protects": False}
    named = json.loads(entry["body"])["variant"]
    same, before = named in (None, variant(source)), first_run is None or entry["at"] < first_run
    return {"found": True, "same_code": same, "before": before, "protects": same and before}


def freeze(spark: SparkSession, folder: str, rows: DataFrame, time: str, source: str, share: float = 0.2, trials: int = 1) -> str:
    """Seal the last ``share`` of the times of ``rows`` for one program; the first sealed time, as text. A folder is sealed once."""
    if not 0.05 <= share <= 0.5 or trials < 1:
        raise ValueError("the sealed share is between 0.05 and 0.5, and there is one trial at least")
    times = rows.select(time).where(F.col(time).isNotNull()).distinct()
    cut = times.orderBy(time).offset(int(times.count() * (1 - share))).limit(1).select(F.col(time).cast("string")).first()
    if cut is None:
        raise ValueError("there is nothing to seal")
    body = {**content(rows), "cut": cut[0], "time": time, "variant": variant(source), "share": share, "trials": trials}
    if append(spark, folder, "freeze", body, only_first=True) is None:
        raise ValueError("this folder holds a sealed part already")
    return cut[0]


def open_once(spark: SparkSession, folder: str, rows: DataFrame, source: str, checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``checks`` makes of the sealed rows, the first time; later calls are refused, noted, and spoil the evidence.

    The claim is made before the rows are read, so a run that is lost after it has used up its one look."""
    frozen = entries(spark, folder).where("kind = 'freeze'").first()
    if frozen is None or problems(spark, folder):
        raise ValueError("the sealed part was never frozen, or its chain was changed")
    body = json.loads(frozen["body"])
    if content(rows) != {k: body[k] for k in ("rows", "data")}:
        raise ValueError("these are not the rows that were sealed")
    if variant(source) != body["variant"]:
        raise ValueError("the program has changed since")
    if not claim(spark, f"{folder}/opened", json.dumps({"at": datetime.now(timezone.utc).isoformat()})):
        append(spark, folder, "reopen", {})
        raise PermissionError("the sealed part was opened before")
    append(spark, folder, "open", {})
    kind = rows.schema[body["time"]].dataType
    checks(rows.where(F.col(body["time"]) >= F.lit(body["cut"]).cast(kind))).write.parquet(f"{folder}/evidence")
    return spark.read.parquet(f"{folder}/evidence")


def standing(spark: SparkSession, folder: str) -> dict:
    """valid, opens, reason: whether the evidence counts."""
    kinds = {r["kind"]: r["n"] for r in entries(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
    reasons = [*problems(spark, folder), *(["it was never frozen"] if "freeze" not in kinds else []), *(["it was not opened yet"] if "open" not in kinds else []), *(["it was opened more than once"] if "reopen" in kinds else [])]
    return {"valid": not reasons, "opens": kinds.get("open", 0), "reason": "; ".join(reasons) or None}
