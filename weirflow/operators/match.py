"""Matching payloads, headers and addresses against tables of rules.

Rules without an equality to join on become literals of one expression, tried in the order of
their ids, so a row is read once and nothing is shuffled; more than RULES_AT_ONCE are tried in
slices, one expression each. Lookups with an equality are plain joins, for which Spark picks the strategy by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import free

RULES_AT_ONCE = 4096


def first_rule(rows: DataFrame, text: str, rules: DataFrame, rule_id: str = "rule_id") -> DataFrame:
    """rows with a column matched: the least id among the rules (content or regex) that fit the text, null if none does.

    The rules are literals, so they go through the driver; a rule file has some thousands.
    """
    found = rules.select(rule_id, "content", "regex").orderBy(rule_id).collect()
    out = rows.withColumn("matched", F.lit(None).cast("int"))
    for k in range(0, len(found), RULES_AT_ONCE):
        tests = [F.when(fits(F.col(text), r["content"], r["regex"]), F.lit(r[rule_id])) for r in found[k : k + RULES_AT_ONCE]]
        out = out.withColumn("matched", F.coalesce("matched", *tests))
    return out


def fits(text: Column, content: str | None, regex: str | None) -> Column:
    out = F.lit(False)
    if content is not None:
        out = out | F.contains(text, F.lit(content))
    if regex is not None:
        out = out | text.rlike(regex)
    return F.coalesce(out, F.lit(False))


def scanned(payload: str = "payload", least: int = 10, depth: int = 600) -> Column:
    """The part of a payload that is looked at; null if it is too short."""
    return F.when(F.length(payload) >= least, F.substring(payload, 1, depth))


def services(rows: DataFrame, payload: str, signatures: DataFrame) -> DataFrame:
    """rows with sig_id, service and title of the first service signature whose regex fits; $1 to $9 in the title stand for what its groups found."""
    text, own = F.col(payload), free(rows, "hit")[0]
    kind = "struct<sig_id:int,service:string,title:string>"
    tests = []
    for s in signatures.orderBy("sig_id").collect():
        parts = [p for p in (s["app"], s["version"], f"({s['misc']})" if s["misc"] else None) if p]
        title = F.lit(" ".join(parts))
        for g in range(1, 10):
            if f"${g}" in " ".join(parts):
                title = F.replace(title, F.lit(f"${g}"), F.regexp_extract(text, s["regex"], g))
        hit = F.struct(F.lit(s["sig_id"]).alias("sig_id"), F.lit(s["service"]).alias("service"), title.alias("title"))
        tests.append(F.when(text.rlike(s["regex"]), hit.cast(kind)))
    out = rows.withColumn(own, F.lit(None).cast(kind))
    for k in range(0, len(tests), RULES_AT_ONCE):
        out = out.withColumn(own, F.coalesce(own, *tests[k : k + RULES_AT_ONCE]))
    return out.select(*rows.columns, f"{own}.sig_id", f"{own}.service", f"{own}.title")


def systems(packets: DataFrame, signatures: DataFrame, key: str = "pkt_id") -> DataFrame:
    """key, sig_id: the first operating-system signature in the order of the file that each packet fits, null for none.

    Packets: size, optcnt, opts, mss, wscale, wsize, ttl, df, quirks, tstamp. Signatures: as the
    reader of the files gives them. Joined on what must be equal (number of options, and the
    options themselves, and quirks); the rest are tests of each pair. A packet that nothing fits
    with df 0 is tried as if df were 1.
    """
    e, s = packets.alias("e"), signatures.withColumn("n_opts", F.size("opts")).alias("s")
    window, mss, mod = F.col("e.wsize"), F.col("e.mss"), F.col("s.win_mode")

    def divides(n: Column, of: Column) -> Column:
        return F.coalesce(F.try_mod(of, n) == 0, F.lit(False))  # nothing is a multiple of 0

    def times(unit: Column, other: int) -> Column:
        """How many units, or else of the other size, the window holds; null if neither fits."""
        return F.when((mss > 0) & divides(unit, window), window / unit).when(window % other == 0, window / other)

    fits_window = F.when(mod == "any", F.lit(True)).when(mod == "value", window == F.col("s.win")).when(mod == "modulo", divides(F.col("s.win"), window)).when(mod == "mss", times(mss, 1460) == F.col("s.win")).otherwise(times(mss + 40, 1500) == F.col("s.win"))

    def agrees(name: str) -> Column:
        own, said = F.col(f"e.{name}"), F.col(f"s.{name}")
        return F.when(F.col(f"s.{name}_mod"), divides(said, own)).otherwise(own == said)

    pair = (
        (F.col("e.optcnt") == F.col("s.n_opts"))
        & (F.col("e.opts") == F.col("s.opts"))
        & (F.col("e.quirks") == F.col("s.quirks"))
        & ((F.col("e.size") == 0) | (F.col("e.size") == F.col("s.size")) | ((F.col("s.size") == 0) & (F.col("e.size") >= 100)))
        & (F.col("s.zero_stamp") == (F.col("e.tstamp") == 0))
        & ((F.col("s.df") == F.col("e.df")) | (F.col("e.df") == 0))
        & agrees("mss")
        & agrees("wscale")
        & fits_window
        & (F.col("s.ttl") >= F.col("e.ttl"))
    )
    # signatures of the packet's own df come before those tried in its place
    hit = F.when(F.col("s.sig_id").isNotNull(), F.struct((F.col("s.df") != F.col("e.df")).alias("retry"), F.col("s.sig_id").alias("sig_id")))
    return e.join(s, pair, "left").groupBy(F.col(f"e.{key}").alias(key)).agg(F.min(hit).alias("hit")).select(key, F.col("hit.sig_id").alias("sig_id"))


def longest_prefix(rows: DataFrame, mac: str, vendors: DataFrame) -> DataFrame:
    """rows with the vendor whose prefix is the longest that a MAC address begins with.

    One equality join for each length of prefix that the table has (a few), each on the address cut
    to that length; so neither side is compared with all of the other.
    """
    digits = F.upper(F.regexp_replace(mac, "[:.-]", ""))
    lengths = sorted(r["bits"] for r in vendors.select("bits").distinct().collect())
    out = rows.withColumn("_bits", F.lpad(F.conv(digits, 16, 2), 48, "0"))
    named = vendors.withColumn("_key", F.substring(F.lpad(F.conv(F.rpad("prefix", 12, "0"), 16, 2), 48, "0"), F.lit(1), F.col("bits")))
    names = []
    for bits in lengths:
        one = named.where(F.col("bits") == bits).groupBy("_key").agg(F.min("vendor").alias(f"_v{bits}")).withColumnRenamed("_key", f"_k{bits}")
        out = out.join(one, F.substring("_bits", 1, bits) == F.col(f"_k{bits}"), "left")
        names.append(f"_v{bits}")
    vendor = F.coalesce(*(F.col(n) for n in reversed(names))) if names else F.lit(None).cast("string")
    return out.select(*rows.columns, vendor.alias("vendor"))


def known_services(packets: DataFrame, ports: DataFrame) -> DataFrame:
    """packets with the service that is known for protocol and destination port."""
    named = ports.withColumnRenamed("port", "dst_port")
    return packets.join(named, ["proto", "dst_port"], "left")


def attackers(alerts: DataFrame, most: int = 9) -> DataFrame:
    """For each source address with alerts: attack_count, how many flows they came from and the first flows, at most `most`.

    Flows are made distinct before they are gathered, so a task holds a source's flows, not its packets.
    """
    per_flow = alerts.groupBy("src_ip", "dst_ip", "src_port", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    flow = F.struct("dst_ip", "src_port", "dst_port")
    from pyspark.sql import Window

    ranked = per_flow.withColumn("k", F.row_number().over(Window.partitionBy("src_ip").orderBy("dst_ip", "src_port", "dst_port")))
    return ranked.groupBy("src_ip").agg(F.sum("n").alias("attack_count"), F.count(F.lit(1)).alias("n_flows"), F.sort_array(F.collect_list(F.when(F.col("k") <= most, flow))).alias("flows"))
