"""Java functions of the package as SQL functions: compiled by the compiler that Spark brings, once for each application and source."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .common import scratch_root

#: SQL function, class and type of its result.
FUNCTIONS = {
    "token_block_encode": ("Encode", "binary"),
    "token_block_parts": ("Parts", "array<binary>"),
    "token_block_checksums": ("Checksums", "array<bigint>"),
    "token_checksums_join": ("JoinChecksums", "bigint"),
}
_LOADED: dict[tuple[str, str], object] = {}


def loader(spark: SparkSession, source: str):
    """The class loader of the compiled classes; their archive lies in the shared folder, from which executors get it."""
    context = spark.sparkContext
    own = (context.applicationId, source)
    if own not in _LOADED:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name(f"{source}.java").read_text())
        archive = io.BytesIO()
        with zipfile.ZipFile(archive, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/functions-{uuid.uuid4().hex}.jar")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(archive.getvalue())
        out.close()
        context._jsc.addJar(path.toString())
        for old in [k for k in _LOADED if k[0] != own[0]]:
            del _LOADED[old]
        _LOADED[own] = compiler.getClassLoader()
    return _LOADED[own]


def instance(spark: SparkSession, name: str, source: str = "TokenBlocks"):
    return loader(spark, source).loadClass(f"stepfree.jvm.{source}${name}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark._jvm.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0))


def register(spark: SparkSession, functions: dict[str, tuple[str, str]] = FUNCTIONS, source: str = "TokenBlocks") -> None:
    """Makes the functions known to the session."""
    for name, (own, kind) in functions.items():
        if not spark.catalog.functionExists(name):
            spark._jsparkSession.udf().register(name, instance(spark, own, source), spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
