"""The kernel's programmes for two plain texts as functions of the executors' JVM (Kernel.java).

The source is compiled once per application by Janino, which comes with
Spark, and goes to the executors as a jar; no other compiler is needed.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arborweave.functions import models

SCORE, PILE, ANCHORED, SUMS, SAMPLE, LOCAL, GRAPH = range(7)
RESULT = {
    SCORE: "struct<score: double, overlap: double, identity: double, reversed: boolean>",
    PILE: "struct<reversed: boolean, overlap: double, identity: double, sites: array<int>, nths: array<int>, symbols: array<string>>",
    ANCHORED: "double",
    SUMS: "struct<forward: double, backward: double, mean_posterior: double>",
    SAMPLE: "struct<n_columns: int, n_match: int>",
    LOCAL: "struct<score: double, a: int, b: int, c: int, d: int>",
    GRAPH: "struct<path: array<int>, left_stop: int, right_stop: int, score: double>",
}
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    """The class loader that has the compiled class; its jar is known to the executors."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader() or sc._jvm.java.lang.ClassLoader.getSystemClassLoader())
        compiler.cook((Path(__file__).parent / "Kernel.java").read_text())
        where = Path(tempfile.mkdtemp(prefix="arborweave-jar")) / f"arborweave-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(where, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(str(where))
        _loaders.clear()
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId]


def function(spark: SparkSession, mode: int, options: models.Options, distance: float, both: bool = False, by: str = "score", least_overlap: float = 0.0, least_identity: float = 0.0, distances: list[float] | None = None, logs: dict[float, float] | None = None):
    """A function (text, text[, third]) -> Column of RESULT[mode]: the programme between two texts at a distance.

    For GRAPH it takes two graphs, structs (states, e_start, e_end, e_weight),
    and their distance, one of `distances`; logs are logarithms of weights.
    """
    sc = spark.sparkContext
    model = models.model(options)
    every = [model.at(d) for d in distances or [distance]]
    k = _loader(spark).loadClass("arborweave.Kernel").getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))
    masks = sorted({*model.symbols.values(), model.unknown})
    number = {m: i for i, m in enumerate(masks)}

    def array(kind, values):
        out = sc._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def put(name: str, value) -> None:
        k.getClass().getField(name).set(k, value)

    for name, value in (("mode", mode), ("step", 3 if options.kind == "codon" else 1), ("size", len(masks)), ("unknown", number[model.unknown]), ("both", both), ("byIdentity", by == "identity"), ("leastOverlap", float(least_overlap)), ("leastIdentity", float(least_identity))):
        put(name, value)
    put("mask", _longs(sc, masks))
    put("shown", array(sc._jvm.java.lang.String, model.decode(masks)))
    put("table", _doubles(sc, [scores.pair(x, y) for scores in every for x in masks for y in masks]))
    put("gaps", _doubles(sc, [v for s in every for v in (s.no_gap, s.open, s.extend, s.close, s.end_extend, s.first_open)]))
    if mode == GRAPH:
        if masks != list(range(1, len(masks) + 1)):
            raise ValueError("graphs are only aligned in the JVM where every state has a number")
        put("distances", _doubles(sc, distances))
        known = sc._jvm.java.util.HashMap()
        for w, v in (logs or {}).items():
            known.put(w, v)
        put("logs", known)
    symbols = sc._jvm.java.util.HashMap()
    for s, m in model.symbols.items():
        symbols.put(s, number[m])
    put("symbols", symbols)
    name = f"arborweave_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(name, k, sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(RESULT[mode]))
    return lambda one, two, three=None: F.call_function(name, one, two, F.lit(None) if three is None else three)


def _doubles(sc, values: list[float]):
    """double[] in one message."""
    import struct

    out = sc._gateway.new_array(sc._jvm.double, len(values))
    sc._jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(values)}d", *values)).asDoubleBuffer().get(out)
    return out


def _longs(sc, values: list[int]):
    """long[] in one message."""
    import struct

    out = sc._gateway.new_array(sc._jvm.long, len(values))
    sc._jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(values)}q", *values)).asLongBuffer().get(out)
    return out
