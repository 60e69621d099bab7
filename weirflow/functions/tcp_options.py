"""TCP options: read from bytes, and written as the text of a fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.rules import QUIRKS

MOST = 15  # options of a header
#: How many bytes follow an option's number, its length byte included; others say it themselves.
SIZES = {0: 0, 1: 0, 2: 3, 3: 2, 4: 1, 8: 9}
#: Fixed value: how many options the text of an ACK shows; where there are fewer, the rest read as end of options.
ACK_SHOWN = 3
#: The order in which quirks are written.
MARKS = "KQ0PZIUXATFDNL!"
STATE = "struct<next:int,broken:boolean,opts:array<int>,mss:int,wscale:int,tstamp:bigint,quirks:int>"


def decode_options(raw: str | Column) -> Column:
    """opts (numbers in order), mss, wscale, tstamp and quirk bits of the bytes of options. Reading stops at what is broken, which is a quirk.

    One pass over the bytes, whose state holds where the next option begins.
    """
    data = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.unhex(F.lit("")))
    n = F.length(data)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int"))

    def step(s: Column, each: Column) -> Column:
        i, b = each["i"], each["b"]
        kind, left = F.get(b, i), F.size(b) - i - 1
        said = F.when(left > 0, F.get(b, i + 1) - 1).otherwise(-1)
        size = said
        for k, v in SIZES.items():
            size = F.when(kind == k, v).otherwise(size)

        def number(first: int, count: int) -> Column:
            out = F.lit(0).cast("bigint")
            for k in range(count):
                out = out * 256 + F.coalesce(F.get(b, i + first + k), F.lit(0))
            return out

        broken = (size < 0) | (size > F.least(F.lit(32), left)) | (F.size(s["opts"]) == MOST)
        late = F.when((kind == 0) & (left > 0), QUIRKS["P"]).when((kind == 8) & (number(6, 4) != 0), QUIRKS["T"]).otherwise(0)
        stopped = F.struct(s["next"].alias("next"), F.lit(True).alias("broken"), s["opts"].alias("opts"), s["mss"].alias("mss"), s["wscale"].alias("wscale"), s["tstamp"].alias("tstamp"), s["quirks"].bitwiseOR(F.lit(QUIRKS["!"])).alias("quirks"))
        taken = F.struct(
            (i + 1 + size).alias("next"), F.lit(False).alias("broken"), F.concat(s["opts"], F.array(kind)).alias("opts"), F.when(kind == 2, number(2, 2).cast("int")).otherwise(s["mss"]).alias("mss"),
            F.when(kind == 3, number(2, 1).cast("int")).otherwise(s["wscale"]).alias("wscale"), F.when(kind == 8, number(2, 4)).otherwise(s["tstamp"]).alias("tstamp"), s["quirks"].bitwiseOR(late).alias("quirks"),
        )
        return F.when(s["broken"] | (i != s["next"]), s).when(broken, stopped.cast(STATE)).otherwise(taken.cast(STATE))

    empty = F.struct(F.lit(0).alias("next"), F.lit(False).alias("broken"), F.array().cast("array<int>").alias("opts"), F.lit(0).alias("mss"), F.lit(0).alias("wscale"), F.lit(0).cast("bigint").alias("tstamp"), F.lit(0).alias("quirks")).cast(STATE)
    # the numbers go along with each place, so that they are made once
    each = F.flatten(F.transform(F.array(numbers), lambda b: F.transform(places, lambda i: F.struct(i.alias("i"), b.alias("b")))))
    return F.aggregate(each, empty, step, lambda s: F.struct(s["opts"].alias("opts"), s["mss"].alias("mss"), s["wscale"].alias("wscale"), s["tstamp"].alias("tstamp"), s["quirks"].alias("quirks")))


def fingerprint_text(kind: str = "syn") -> Column:
    """window:ttl:df:size:options:quirks of a packet with the columns of decode_options and wsize, ttl, df, size. The window as a multiple of the segment or link size where it is one."""
    mss, win = F.col("mss"), F.col("wsize")

    def multiple(letter: str, of: Column) -> Column:
        return F.when((win > 0) & (F.coalesce(F.try_mod(win, of), F.lit(1)) == 0), F.concat(F.lit(letter), (win / of).cast("int").cast("string")))

    window = F.coalesce(F.when(mss > 0, multiple("S", mss)), multiple("S", F.lit(1460)), F.when(mss > 0, multiple("T", mss + 40)), multiple("T", F.lit(1500)), F.when(win == 12345, "*(12345)"), win.cast("string"))
    size = F.when(F.lit(kind in ("ack", "rst")), "*").when(F.col("size") < 100, F.col("size").cast("string")).otherwise(F.format_string("*(%d)", F.col("size")))

    def letter(o: Column) -> Column:
        stamp = F.when(F.col("tstamp") == 0, "T0").otherwise("T")
        return F.when(o == 1, "N").when(o == 3, F.concat(F.lit("W"), F.col("wscale").cast("string"))).when(o == 2, F.concat(F.lit("M"), mss.cast("string"))).when(o == 8, stamp).when(o == 4, "S").when(o == 0, "E").otherwise(F.concat(F.lit("?"), o.cast("string")))

    shown = F.slice(F.concat("opts", F.array_repeat(F.lit(0), ACK_SHOWN)), 1, ACK_SHOWN) if kind == "ack" else F.col("opts")
    listed = F.array_join(F.transform(shown, letter), ",")
    marks = F.concat(*(F.when(F.col("quirks").bitwiseAND(F.lit(QUIRKS[c])) != 0, c).otherwise("") for c in MARKS))
    return F.concat_ws(":", window, F.col("ttl").cast("string"), F.col("df").cast("string"), size, F.when(F.length(listed) < 2, F.concat(listed, F.lit("."))).otherwise(listed), F.when(marks == "", ".").otherwise(marks))
