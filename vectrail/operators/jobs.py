"""Job descriptions: source, operation and sink as one lazily built DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from vectrail.operators import backends
from vectrail.operators.tables import project_fields, upsert
from vectrail.sources import readers

OPERATIONS = ("encode", "extract", "generate")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def connection_name(uri: str) -> str:
    """The authority of a connection's address, such as ``orders`` in ``postgres://orders/table``."""
    address = urlsplit(uri)
    if not (address.scheme and _NAME.fullmatch(address.netloc)):
        raise ValueError(f"no connection in {uri!r}")
    return address.netloc


def schema_policy(connection_type: str, source_schema: str | None, sink_schema: str | None) -> tuple[str, str] | None:
    """The schemas of a postgres job, of which there are two or none, each a plain identifier."""
    given = tuple(x for x in (source_schema, sink_schema) if x is not None)
    if not given:
        return None
    problems = {
        "a source schema needs a sink schema, and the other way round": len(given) == 1,
        f"{connection_type} connections have no schemas": connection_type != "postgres",
        "a schema is a plain identifier": not all(map(_IDENTIFIER.fullmatch, given)),
    }
    if found := [text for text, is_so in problems.items() if is_so]:
        raise ValueError("; ".join(found))
    return given


def resolve_profile(profiles: dict[str, dict], name: str) -> dict:
    """A named profile: one that ``extends`` another, which extends none, takes the fields it does not set from it.

    A field that is set replaces the other's whole value, except ``adaptive``, whose own fields are merged.
    """
    own = profiles[name]
    if not (base_name := own.get("extends")):
        return dict(own)
    base = profiles[base_name]
    if base.get("extends"):
        raise ValueError(f"{base_name} extends another profile itself")
    found = {**base, **own, "adaptive": {**base.get("adaptive", {}), **own.get("adaptive", {})}}
    return {k: v for k, v in found.items() if k != "extends" and not (k == "adaptive" and not v)}


def request_options(profile: dict, request: dict) -> dict:
    """The profile's ``runtime`` options, over which a request's own have their way; its ``profile`` key is none."""
    return profile.get("runtime", {}) | {k: v for k, v in request.items() if k != "profile"}


def join_path(base: str, *parts: str) -> str:
    """A path below ``base``, which may be a folder or an address of a store; one slash between parts."""
    return "/".join([base.rstrip("/"), *(p.strip("/") for p in parts if p.strip("/"))])


def in_store(path: str) -> bool:
    """Whether a path is in an object store that Spark reads by its scheme."""
    return urlsplit(path).scheme in ("s3", "s3a", "gs", "abfs", "abfss")


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of all ``frames`` as CSV with a header: the sorted union of their columns, null where a frame lacks one."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    whole.select(sorted(whole.columns)).write.option("header", True).csv(path)


@dataclass
class JobSpec:
    """``source``: rows, or a path with a format; ``sink``: ``return``, ``inplace`` or a path.

    ``inplace`` writes a folder beside the source, as Spark cannot overwrite what it
    reads. What is there already is replaced only with ``overwrite``.
    """

    source: list | str
    operation: str
    source_format: str = "parquet"
    field_map: dict = field(default_factory=lambda: {"id_field": "id", "input_field": "text"})
    options: dict = field(default_factory=dict)
    sink: str = "return"
    execution: str | None = None
    overwrite: bool = False

    def build(self, spark: SparkSession) -> DataFrame:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation: {self.operation}")
        if isinstance(self.source, list):
            if self.execution:
                raise ValueError("inline jobs take no execution")
            items = readers.inline_items(spark, self.source)
        else:
            if self.execution not in ("plan", "run"):
                raise ValueError("execution is plan or run")
            items = project_fields(readers.read_path(spark, self.source, self.source_format), self.field_map)
        return getattr(backends, self.operation)(items, **self.options)

    def run(self, spark: SparkSession) -> DataFrame:
        """The result; written unless the sink is ``return`` or the execution is ``plan``."""
        out = self.build(spark)
        if self.sink == "return" or self.execution == "plan":
            return out
        if self.sink == "inplace":
            if isinstance(self.source, list):
                raise ValueError("inline items have no place to write to")
            path = self.source.rstrip("/") + ".enriched"
        else:
            path = self.sink
            if urlsplit(path).scheme:
                connection_name(path)
        out.write.mode("overwrite" if self.overwrite else "errorifexists").parquet(path)
        return spark.read.parquet(path)


def merge_into(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], to: str) -> None:
    """Insert-or-update of a Parquet table, written to ``to``."""
    upsert(spark.read.parquet(path), rows, keys).write.mode("overwrite").parquet(to)


def publish_run(df: DataFrame, root: str, run_id: str) -> str:
    """Writes a run's rows beside ``root``'s runs and then renames the folder, so a run is seen whole or not at all; its path.

    A run that fails leaves what it wrote in ``failed`` and raises; a run of that
    name that is there already raises before anything is written.
    """
    if not run_id or "/" in run_id or run_id.startswith((".", "_")):
        raise ValueError("a run needs a plain name")
    spark = df.sparkSession
    place = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path(join_path(root, *parts))
    files = place().getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place("runs", run_id)):
        raise FileExistsError(run_id)

    def move(to: str) -> None:
        files.mkdirs(place(to))
        if not files.rename(place("_staged", run_id), place(to, run_id)):
            raise OSError(f"could not publish {run_id}")

    try:
        df.write.mode("overwrite").parquet(join_path(root, "_staged", run_id))
    except Exception:
        files.mkdirs(place("_staged", run_id))
        files.delete(place("failed", run_id), True)
        move("failed")
        raise
    move("runs")
    return join_path(root, "runs", run_id)
