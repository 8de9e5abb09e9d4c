"""Java code of this package in Spark: compiled once per application by the compiler that Spark itself generates code with."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.column import Column as Classic

from ..session import shared_folder

_classes: dict[str, object] = {}


def java_class(spark: SparkSession, name: str):
    """The class ``panelwright.<name>`` of the source beside this module; its jar is added to the application."""
    at = f"{spark.sparkContext.applicationId}/{name}"
    if at not in _classes:
        jvm = spark.sparkContext._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(loader)
        compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for entry in compiler.getBytecodes().entrySet():
                archive.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        jar = f"{shared_folder(spark)}/modules/panelwright-{name}.jar"
        path = jvm.org.apache.hadoop.fs.Path(jar)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        spark._jsc.addJar(jar)
        _classes[at] = compiler.getClassLoader().loadClass(f"panelwright.{name}")
    return _classes[at]


def static(spark: SparkSession, found, name: str, *arguments):
    """What a static method of a class gives."""
    (method,) = [m for m in found.getMethods() if m.getName() == name]
    return method.invoke(None, _array(spark, arguments))


def instance(spark: SparkSession, found, *arguments):
    """A new object of a class with one constructor."""
    return found.getConstructors()[0].newInstance(_array(spark, arguments))


def java_long(spark: SparkSession, value: int):
    return spark.sparkContext._jvm.java.lang.Long(str(value))


def _array(spark: SparkSession, values):
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(gateway.jvm.java.lang.Object, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out


def call(spark: SparkSession, function, returns: str, argument: Column) -> Column:
    """The column that a Java object with one argument gives."""
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL(returns)
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    (method,) = [  # chosen by its parameter, as py4j would take the one for any object
        m for m in loader.loadClass("org.apache.spark.sql.functions").getMethods()
        if m.getName() == "udf" and m.getParameterTypes()[0].getSimpleName() == "UDF1"]
    made = method.invoke(None, _array(spark, [function, kind])).asNondeterministic()
    columns = spark.sparkContext._gateway.new_array(jvm.org.apache.spark.sql.Column, 1)
    columns[0] = argument._jc
    return Classic(made.apply(columns))
