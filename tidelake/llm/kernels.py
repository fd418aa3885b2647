"""Kernels for the JVM: loops over bytes and ids that neither Spark's expressions nor arrays express well.

Their sources are in ``java/``. The driver compiles them with Janino, the compiler that Spark itself uses for its
generated code, puts the classes into a jar in the shared folder and adds it to the session; executors fetch it from
there, also those that join later. A kernel takes the rows of a partition one by one and gives rows; nothing but its
arguments is sent along.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import shared_dir

_added: dict[tuple[str, str], object] = {}


@cache
def _source() -> str:
    """All sources as one unit: the package, the imports, then the classes."""
    imports, bodies = set(), []
    for f in sorted(files("tidelake.llm").joinpath("java").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".java"):
            text = f.read_text()
            imports |= set(re.findall(r"^import [^;]+;$", text, re.M))
            bodies.append(re.sub(r"^(?:package|import) [^;]+;$", "", text, flags=re.M))
    return "\n".join(["package tidelake.llm;", *sorted(imports), *bodies])


def _loader(spark: SparkSession):
    """The loader of the session's added classes; compiles and adds them first, once for each session."""
    app = spark.sparkContext.applicationId
    session = spark._jsparkSession.sessionUUID()
    if (app, session) not in _added:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(_source())
        made = compiler.getBytecodes()
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name in sorted(made):
                z.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), bytes(made[name]))
        name = f"{shared_dir(spark)}/kernels-{hashlib.sha256(jar.getvalue()).hexdigest()[:16]}-{session}.jar"
        path = jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(jar.getvalue())
        out.close()
        spark.sql(f"ADD JAR '{name}'")
        _added[app, session] = spark._jsparkSession.sharedState().jarClassLoader()
    return _added[app, session]


def _made(spark: SparkSession, kernel: str, args: tuple):
    """An instance of the kernel; args are strings, numbers and booleans."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    given = gateway.new_array(jvm.java.lang.Object, len(args))
    for i, x in enumerate(args):
        given[i] = x
    kinds = gateway.new_array(jvm.java.lang.Class, 1)
    kinds[0] = given.getClass()
    inner = gateway.new_array(jvm.java.lang.Object, 1)
    inner[0] = given
    return _loader(spark).loadClass(f"tidelake.llm.{kernel}").getDeclaredConstructor(kinds).newInstance(inner)


def _kind(spark: SparkSession, schema: str | T.DataType):
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark._jsparkSession.parseDataType(schema.json())


def apply(df: DataFrame, kernel: str, schema: str | T.StructType, *args) -> DataFrame:
    """The rows that the kernel makes of each partition of ``df``."""
    spark = df.sparkSession
    encoder = spark._jvm.org.apache.spark.sql.Encoders.row(_kind(spark, schema))
    return DataFrame(df._jdf.mapPartitions(_made(spark, kernel, args), encoder), spark)


def function(spark: SparkSession, kernel: str, kind: str | T.DataType, *args) -> Callable[[Column | str], Column]:
    """The kernel as a function of a column."""
    name = f"tidelake_{kernel.lower()}_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(name, _made(spark, kernel, args), _kind(spark, kind))
    return lambda column: F.call_function(name, column)
