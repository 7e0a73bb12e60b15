"""Functions in Java for what a Python worker does one object at a time, compiled by the compiler that Spark brings for its generated code."""

from __future__ import annotations

import os
import tempfile
import zipfile

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

PACKAGE = "spanloom"

#: Draws of ``bootstrap.counter_draw``: places ``low`` to ``high`` of a sample whose counters begin at ``base``, as 32-bit numbers.
#: ``starts`` are the first places of the strata and the number of all; a draw stays in the stratum of its place.
DRAWS = """
package spanloom;

public final class Draws implements org.apache.spark.sql.api.java.UDF5 {
  private static final long serialVersionUID = 1L;

  public Object call(Object head_, Object base_, Object low_, Object high_, Object starts_) throws Exception {
    byte[] head = (byte[]) head_;
    long base = ((Number) base_).longValue();
    int low = ((Number) low_).intValue(), high = ((Number) high_).intValue(), size = head.length + 16, k = 0;
    String[] parts = ((String) starts_).split(",");
    int[] starts = new int[parts.length];
    for (int i = 0; i < parts.length; i++) starts[i] = Integer.parseInt(parts[i]);
    java.security.MessageDigest sha = java.security.MessageDigest.getInstance("SHA-256");
    byte[] message = java.util.Arrays.copyOf(head, size), digest = new byte[32], out = new byte[Math.max(0, 4 * (high - low))];
    long[] powers = new long[8];
    long n = 0;
    for (int i = low, at = 0; i < high; i++) {
      if (n == 0 || i >= starts[k + 1]) {
        while (i >= starts[k + 1]) k++;
        n = starts[k + 1] - starts[k];
        powers[7] = 1 % n;
        for (int j = 6; j >= 0; j--) powers[j] = (powers[j + 1] << 32) % n;
      }
      long counter = base + i, r = 0;
      for (int j = 1; j <= 8; j++) { message[size - j] = (byte) counter; counter >>>= 8; }
      sha.update(message, 0, size);
      sha.digest(digest, 0, 32);
      for (int j = 0, d = 0; j < 8; j++, d += 4) {
        long word = ((digest[d] & 255L) << 24) | ((digest[d + 1] & 255L) << 16) | ((digest[d + 2] & 255L) << 8) | (digest[d + 3] & 255L);
        r += n < (1 << 28) ? word * powers[j] : word * powers[j] % n;
      }
      int v = starts[k] + (int) (r % n);
      out[at++] = (byte) v; out[at++] = (byte) (v >>> 8); out[at++] = (byte) (v >>> 16); out[at++] = (byte) (v >>> 24);
    }
    return out;
  }
}
"""


def java_function(spark: SparkSession, source: str, name: str, returns: str) -> str | None:
    """Name of the temporary SQL function that runs class ``name`` of ``source``, or None where it cannot be had and Python must do.

    The class is compiled on the driver once a session, and a jar takes it to the executors.
    """
    function = f"{PACKAGE}_{name.lower()}"
    try:
        if spark.catalog.functionExists(function):
            return function
        jvm, session = spark._jvm, spark._jsparkSession
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(session.getClass().getClassLoader())
        compiler.cook(source)
        folder = tempfile.mkdtemp(prefix="spanloom-")
        path = os.path.join(folder, f"{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for own, code in compiler.getBytecodes().items():
                jar.writestr(own.replace(".", "/") + ".class", bytes(code))
        for made in (folder, path):  # deleted in reverse order when the driver's JVM ends
            jvm.java.io.File(made).deleteOnExit()
        spark.sql(f"ADD JAR '{path}'")
        instance = compiler.getClassLoader().loadClass(f"{PACKAGE}.{name}").newInstance()
        session.udf().register(function, instance, session.parseDataType(f'"{returns}"'))
    except (AttributeError, Py4JError, PySparkException, OSError):
        return None
    return function
