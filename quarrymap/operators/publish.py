"""Maps written as canonical JSON, section by section, and published in two phases.

A row becomes a line of JSON whose keys are sorted at every depth, so that equal rows give equal bytes. A map is written into a folder of its own;
only when all of it is there a manifest that names it takes the place of the one before, in one rename. A reader sees the old map or the
new one, and a writer that fails leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.operators.ranks import with_rank
from quarrymap.storage import delete_folder, stored


def canonical(c: Column, kind: T.DataType) -> Column:
    """c with the fields of its structs and the keys of its maps in the order of their names, at every depth. Lists keep their order."""
    if isinstance(kind, T.StructType):
        fields = [canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: canonical(v, kind.valueType)))))
    return c


def canonical_json(df: DataFrame) -> Column:
    fields = [canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of another in one rename."""
    jvm, p, fs = _files(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(temporary), context.makeQualified(p), options)


def write_map(root: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> dict:
    """Publish sections name -> (rows, columns that they are ordered by; of equal ones their JSON decides) under root; what it returns is the manifest.

    Each section is text, a line a row in order, in as many files as ranges. Its digest is of the number of rows and the sum of hashes of
    (place, line), so that it depends on the rows and their order and not on how they were dealt."""
    spark = next(iter(sections.values()))[0].sparkSession
    folder = f"map-{uuid.uuid4().hex}"
    told: dict = {"folder": folder, "sections": {}}
    try:
        for name in sorted(sections):
            rows, order = sections[name]
            lines = rows.select(canonical_json(rows).alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
            ranked = stored(with_rank(lines, [f"_{i}" for i in range(len(order))] + ["value"]), "section")
            n, total = ranked.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("rank", "value").cast("decimal(38,0)")), F.lit(0))).first()
            ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.text(f"{root}/{folder}/{name}")
            told["sections"][name] = {"rows": n, "digest": hashlib.sha256(f"{n}:{int(total)}".encode()).hexdigest()}
        told["digest"] = hashlib.sha256(json.dumps(told["sections"], sort_keys=True).encode()).hexdigest()
        _replace(spark, f"{root}/manifest.json", json.dumps(told, sort_keys=True) + "\n")
    except BaseException:
        delete_folder(spark, f"{root}/{folder}")
        raise
    return told


def manifest(spark: SparkSession, root: str) -> dict | None:
    text = read_text(spark, f"{root}/manifest.json")
    return json.loads(text) if text else None


def read_section(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of one section of the published map; other sections aren't read."""
    now = manifest(spark, root)
    if now is None or name not in now["sections"]:
        raise ValueError(f"no section {name} under {root}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/{now['folder']}/{name}")
