"""The block coder of token ids: an adaptive context-mixing range coder on the JVM.

A block codes its ids alone: every table starts afresh, and a checksum of the ids closes it. Two ids are predicted, the
one that last followed the two ids before (order 2) and the one that last followed the id before (order 1); "it is this
one" is a binary decision, coded by a mix of three adaptive probabilities - of the order-2 slot's confidence, of the
order-1 slot's confidence and agreement, and of the last outcomes - in the logistic domain, with weights that learn (an
order-1 guess that was never right yet is passed over). An id that neither predicts is coded at once by its order-0
frequency, in one step of the coder: counts are kept of all such ids, and the cumulative table is made from them anew
after 256 of them, then after twice as many each time, and from REFRESH on after as many again. Decisions and ids drive
one range coder of 32 bits with carry.

Layout of a block: "SFID", version 2, bits of an id (one byte), number of ids and CRC-32 of the ids as little-endian
32-bit integers (each big-endian 32 bits), then the code. The Java source is compiled by the Janino compiler that Spark
itself uses, and reaches the executors as a jar of the session.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T

NAME = "spanframe.coder.IdCoder"
SOURCE = r"""
package spanframe.coder;

public class IdCoder implements org.apache.spark.sql.api.java.UDF1 {
  public Object call(Object raw) throws Exception { return raw == null ? null : new Block().encode((byte[]) raw); }

  /** The documents of a block, by where each ends: their ids as little-endian 32-bit integers. */
  public static class Reader implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object block, Object ends) throws Exception {
      if (block == null) return null;
      byte[] raw = new Block().decode((byte[]) block);
      scala.collection.Seq at = (scala.collection.Seq) ends;
      Object[] out = new Object[at.size()];
      int from = 0;
      for (int i = 0; i < out.length; i++) {
        int to = 4 * ((Number) at.apply(i)).intValue();
        out[i] = java.util.Arrays.copyOfRange(raw, from, to);
        from = to;
      }
      if (from != raw.length) throw new IllegalStateException("a block of ids and its index disagree");
      return out;
    }
  }

  static final int REFRESH = 8192, GAIN = 12, MOST = 1 << 21;
  static final float[] STRETCH = new float[4096];
  static final int[] SQUASH = new int[4096];
  static {
    for (int i = 0; i < 4096; i++) {
      double p = (i + 0.5) / 4096;
      STRETCH[i] = (float) Math.log(p / (1 - p));
      SQUASH[i] = Math.max(32, Math.min(65535 - 32, (int) (65536 / (1 + Math.exp((2048 - i) / 170.0)))));
    }
  }

  static class Block {
    byte[] buf; int at; boolean decoding;
    // the coder: an interval of `range` from `low` on; bytes that a carry may still change wait in `held` and `pending`
    long low = 0, range = 0xffffffffL, code = 0; int held = -1; long pending = 0;

    void put(int b) {
      if (at == buf.length) buf = java.util.Arrays.copyOf(buf, buf.length * 2);
      buf[at++] = (byte) b;
    }

    void shift() {
      if (low < 0xff000000L || low > 0xffffffffL) {
        int carry = (int) (low >>> 32);
        if (held >= 0) put(held + carry);
        for (; pending > 0; pending--) put(0xff + carry);
        held = (int) (low >>> 24) & 0xff;
      } else pending++;
      low = (low & 0x00ffffffL) << 8;
    }

    void settle() {
      while (range < 0x1000000L) {
        range = (range << 8) & 0xffffffffL;
        if (decoding) code = ((code << 8) & 0xffffffffL) | (at < buf.length ? buf[at++] & 0xff : 0);
        else shift();
      }
    }

    int bit(int y, int p) {  // p: of a one, in 65536ths
      long bound = (range >>> 16) * p;
      if (decoding) y = code < bound ? 1 : 0;
      if (y == 1) range = bound;
      else { range -= bound; if (decoding) code -= bound; else low += bound; }
      settle();
      return y;
    }

    // order 0: counts of ids, and the cumulative table that codes until it is made anew
    int size; int[] count, upto, first; int shiftOf, left = 256, every = 256;

    void refresh() {
      int total = 0;
      for (int i = 0; i < size; i++) { upto[i] = total; total += count[i]; }
      upto[size] = total;
      if (total > MOST) {
        for (int i = 0; i < size; i++) count[i] = (count[i] + 1) >>> 1;
        refresh();
        return;
      }
      if (!decoding) return;
      // where to look for an id: the first one of each stretch of the table
      shiftOf = Math.max(0, 32 - Integer.numberOfLeadingZeros(total) - 14);
      int s = 0;
      for (int b = 0; b < first.length; b++) {
        long v = (long) b << shiftOf;
        while (s < size - 1 && upto[s + 1] <= v) s++;
        first[b] = s;
      }
    }

    int literal(int id) {
      int total = upto[size];
      boolean small = range <= Integer.MAX_VALUE;  // the division of ints is far faster
      long step = small ? (int) range / total : range / total;
      if (decoding) {
        int v = (int) Math.min(small ? (int) code / (int) step : code / step, total - 1);
        int lo = first[v >>> shiftOf], hi = Math.min(size - 1, first[Math.min(first.length - 1, (v >>> shiftOf) + 1)]);
        while (lo < hi) {
          int mid = (lo + hi + 1) >>> 1;
          if (upto[mid] <= v) lo = mid; else hi = mid - 1;
        }
        id = lo;
        code -= step * upto[id];
      } else low += step * upto[id];
      range = step * (upto[id + 1] - upto[id]);
      settle();
      count[id] += GAIN;
      if (--left == 0) {
        refresh();
        if (every < REFRESH) every *= 2;
        left = every;
      }
      return id;
    }

    // orders 1 and 2: the last id of a context plus one, and its confidence
    int[] one = new int[1 << 16]; byte[] sure1 = new byte[1 << 16];
    int[] two = new int[1 << 16]; byte[] sure2 = new byte[1 << 16];
    int[] bySure2 = half(2 * 16), bySure1 = half(2 * 48), byLast = half(2 * 256);
    float[] weight = new float[] {0.4f, 0.4f, 0.4f, 0.4f, 0.4f, 0.4f};
    int last = 0;

    static int[] half(int n) { int[] a = new int[n]; java.util.Arrays.fill(a, 32768); return a; }

    int hit(int y, int which, int c2, int c1) {
      int a = which * 16 + c2, b = which * 48 + c1, c = which * 256 + (last & 255), w = which * 3;
      float sa = STRETCH[bySure2[a] >>> 4], sb = STRETCH[bySure1[b] >>> 4], sc = STRETCH[byLast[c] >>> 4];
      float dot = weight[w] * sa + weight[w + 1] * sb + weight[w + 2] * sc;
      int p = SQUASH[Math.max(0, Math.min(4095, 2048 + (int) (dot * 170)))];
      y = bit(y, p);
      float err = (y * 65536 - p) * (0.02f / 65536);
      weight[w] += err * sa; weight[w + 1] += err * sb; weight[w + 2] += err * sc;
      bySure2[a] += ((y * 65535) - bySure2[a]) >> 6;
      bySure1[b] += ((y * 65535) - bySure1[b]) >> 6;
      byLast[c] += ((y * 65535) - byLast[c]) >> 6;
      last = (last << 1) | y;
      return y;
    }

    int p1 = 0, p2 = 0;

    int symbol(int id) {
      int h2 = ((p1 + 1) * 0x9E3779B1 ^ (p2 + 1) * 0x85EBCA6B) >>> 16, h1 = (p1 * 0x9E3779B1) >>> 16;
      int g2 = two[h2] - 1, g1 = one[h1] - 1, c2 = sure2[h2];
      int c1 = sure1[h1] + (g1 < 0 ? 0 : g1 == g2 ? 16 : 32);
      int got = -1;
      if (g2 >= 0 && hit(id == g2 ? 1 : 0, 0, c2, c1) == 1) got = g2;
      if (got < 0 && g1 >= 0 && g1 != g2 && sure1[h1] > 0 && hit(id == g1 ? 1 : 0, 1, c2, c1) == 1) got = g1;
      if (got < 0) got = literal(id);
      if (g2 == got) { if (c2 < 15) sure2[h2]++; } else { two[h2] = got + 1; sure2[h2] = (byte) (c2 >> 2); }
      if (g1 == got) { if (sure1[h1] < 15) sure1[h1]++; } else if (sure1[h1] > 2) sure1[h1] -= 2; else { one[h1] = got + 1; sure1[h1] = 0; }
      p2 = p1; p1 = got;
      return got;
    }

    void start(int bits) {
      if (bits < 1 || bits > 20) throw new IllegalArgumentException("ids of over 20 bits");
      size = 1 << bits;
      count = new int[size]; upto = new int[size + 1]; first = new int[decoding ? (1 << 14) + 1 : 0];
      java.util.Arrays.fill(count, 1);
      refresh();
    }

    byte[] encode(byte[] raw) {
      if (raw.length % 4 != 0) throw new IllegalArgumentException("ids are 32-bit integers");
      java.nio.IntBuffer ids = java.nio.ByteBuffer.wrap(raw).order(java.nio.ByteOrder.LITTLE_ENDIAN).asIntBuffer();
      int n = raw.length / 4, most = 1;
      for (int i = 0; i < n; i++) most |= ids.get(i);
      int bits = 32 - Integer.numberOfLeadingZeros(most);
      java.util.zip.CRC32 crc = new java.util.zip.CRC32();
      crc.update(raw, 0, raw.length);
      start(bits);
      buf = new byte[64 + raw.length / 2];
      byte[] head = java.nio.ByteBuffer.allocate(14).put((byte) 'S').put((byte) 'F').put((byte) 'I').put((byte) 'D').put((byte) 2).put((byte) bits).putInt(n).putInt((int) crc.getValue()).array();
      System.arraycopy(head, 0, buf, 0, 14);
      at = 14;
      for (int i = 0; i < n; i++) symbol(ids.get(i));
      for (int i = 0; i < 5; i++) shift();
      return java.util.Arrays.copyOf(buf, at);
    }

    byte[] decode(byte[] block) {
      java.nio.ByteBuffer head = java.nio.ByteBuffer.wrap(block);
      if (block.length < 18 || head.getInt() != 0x53464944 || head.get() != 2) throw new IllegalArgumentException("not a block of ids");
      decoding = true;
      start(head.get());
      int n = head.getInt(), sum = head.getInt();
      buf = block; at = 14;
      for (int i = 0; i < 4; i++) code = (code << 8) | (buf[at++] & 0xff);
      byte[] raw = new byte[4 * n];
      java.nio.IntBuffer ids = java.nio.ByteBuffer.wrap(raw).order(java.nio.ByteOrder.LITTLE_ENDIAN).asIntBuffer();
      for (int i = 0; i < n; i++) ids.put(i, symbol(-2));
      java.util.zip.CRC32 crc = new java.util.zip.CRC32();
      crc.update(raw, 0, raw.length);
      if ((int) crc.getValue() != sum) throw new IllegalStateException("a block of ids fails its checksum");
      return raw;
    }
  }
}
"""
_DONE: dict[str, object] = {}


def register(spark: SparkSession) -> tuple[str, str]:
    """Names of the SQL functions of this session that encode a block of ids, and decode one into its documents by their ends."""
    context = spark.sparkContext
    if _DONE.get("app") != context.applicationId:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        code = compiler.getBytecodes()
        folder = tempfile.mkdtemp(prefix="spanframe-coder-")  # the driver's own: it serves the jar from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = os.path.join(folder, "id_coder.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in code:
                z.writestr(name.replace(".", "/") + ".class", bytes(code[name]))
        context._jsc.addJar(jar)  # the driver serves it to every executor, later ones too
        _DONE.update(app=context.applicationId, loader=compiler.getClassLoader())
    for name, cls, kind in (("spanframe_encode_ids", NAME, T.BinaryType()), ("spanframe_decode_ids", f"{NAME}$Reader", T.ArrayType(T.BinaryType()))):
        made = _DONE["loader"].loadClass(cls).getConstructors()[0].newInstance(context._gateway.new_array(context._jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(name, made, context._jvm.org.apache.spark.sql.types.DataType.fromJson(kind.json()))
    return "spanframe_encode_ids", "spanframe_decode_ids"
