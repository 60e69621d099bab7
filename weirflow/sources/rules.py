"""Readers of rule, signature, vendor and configuration files, and fixed dimension tables. All parse with column functions, so files may be large and lie in any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (protocol, port, name) of well-known services.
KNOWN_PORTS = [
    (6, 20, "@ftp-data"), (6, 21, "@ftp"), (6, 22, "@ssh"), (6, 25, "@smtp"), (17, 53, "@domain"), (6, 80, "@www"),
    (6, 110, "@pop3"), (6, 111, "@sunrpc"), (17, 111, "@sunrpc"), (6, 113, "@auth"), (6, 115, "@sftp"), (6, 119, "@nntp"),
    (17, 123, "@ntp"), (6, 143, "@imap2"), (6, 161, "@snmp"), (17, 161, "@snmp"), (6, 162, "@snmp-trap"), (17, 162, "@snmp-trap"),
    (6, 389, "@ldap"), (6, 443, "@https"), (6, 445, "@microsoft-ds"), (17, 514, "@syslog"), (6, 554, "@rtsp"), (17, 554, "@rtsp"),
    (6, 631, "@ipp"), (6, 990, "@ftps"), (6, 992, "@telnets"), (6, 993, "@imaps"), (6, 995, "@pop3s"), (17, 1194, "@openvpn"),
    (6, 2049, "@nfs"), (17, 2049, "@nfs"), (6, 3306, "@mysql"), (6, 6667, "@irc"),
]

#: Largest packet of a link and what link that tells of.
LINK_TYPES = [
    (256, "radio modem"), (386, "ethernut"), (552, "SLIP line / encap ppp"), (576, "sometimes modem"), (1280, "gif tunnel"),
    (1300, "PIX, SMC, sometimes wireless"), (1362, "sometimes DSL (1)"), (1372, "cable modem"), (1400, "(Google/AOL)"), (1408, "virtualization"),
    (1415, "sometimes wireless"), (1420, "GPRS, T1, FreeS/WAN"), (1423, "sometimes cable"), (1440, "sometimes DSL (2)"), (1442, "IPIP tunnel"),
    (1450, "vtun"), (1452, "sometimes DSL (3)"), (1454, "sometimes DSL (4)"), (1456, "ISDN ppp"), (1458, "BT DSL (?)"),
    (1460, "3G WAN"), (1462, "sometimes DSL (5)"), (1470, "(Google 2)"), (1476, "IPSec/GRE"), (1480, "IPv6/IPIP"),
    (1492, "pppoe (DSL)"), (1496, "vLAN"), (1500, "ethernet/modem"), (1656, "Ericsson HIS"), (2024, "wireless/IrDA"),
    (2048, "Cyclom X.25 WAN"), (2250, "AiroNet wireless"), (3924, "loopback"), (4056, "token ring (1)"), (4096, "Sangoma X.25 WAN"),
    (4352, "FDDI"), (4500, "token ring (2)"), (9180, "FORE ATM"), (16384, "sometimes loopback (1)"), (16436, "sometimes loopback (2)"),
    (18000, "token ring x4"),
]


def known_ports(spark: SparkSession) -> DataFrame:
    """proto, port, service. A port's name is that of its first row, for each protocol that has a row."""
    first: dict[int, str] = {}
    for _, port, name in KNOWN_PORTS:
        first.setdefault(port, name)
    return spark.createDataFrame([(proto, port, first[port]) for proto, port, _ in KNOWN_PORTS], "proto int, port int, service string")


def link_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINK_TYPES, "mtu int, link string")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line, value: the lines of one file with their numbers from 1, comments and blank lines left out."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).select((F.col("n") + 1).alias("line"), F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def ids_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_id (from 1), content, regex: of each rule line, its first content and its first pcre, without quotes and delimiters; of the flags, i is kept."""
    lines = numbered(spark, path)
    content, pcre = F.regexp_extract("value", r'content:"([^"]+)"', 1), F.regexp_extract("value", r'pcre:"([^"]+)"', 1)
    body, flags = F.regexp_extract(pcre, r"^/(.*)/([a-zA-Z]*)$", 1), F.regexp_extract(pcre, r"^/(.*)/([a-zA-Z]*)$", 2)
    regex = F.when(pcre == "", None).otherwise(F.concat(F.when(flags.contains("i"), "(?i)").otherwise(""), F.when(body == "", pcre).otherwise(body)))
    out = lines.select("line", F.when(content != "", content).alias("content"), regex.alias("regex")).where("content is not null or regex is not null")
    return out.withColumn("rule_id", F.row_number().over(by_line())).select("rule_id", "content", "regex")


def by_line():
    from pyspark.sql import Window

    return Window.orderBy("line")  # a rule file is one small file


def service_signatures(spark: SparkSession, path: str) -> DataFrame:
    """sig_id (from 0, in the order of the file), service, app, version, misc, regex: of lines service,v/app/version/misc/,regex."""
    parts = F.split("value", ",", 3)
    title = F.split(F.element_at(parts, 2), "/")
    get = lambda k: F.get(title, F.lit(k))
    out = numbered(spark, path).where(F.size(parts) == 3).select("line", F.element_at(parts, 1).alias("service"), get(1).alias("app"), get(2).alias("version"), get(3).alias("misc"), F.element_at(parts, 3).alias("regex"))
    return out.withColumn("sig_id", F.row_number().over(by_line()) - 1).drop("line")


def mac_vendors(spark: SparkSession, path: str) -> DataFrame:
    """prefix (hex digits without marks), bits, vendor: of lines AA:BB:CC[/bits] vendor # comment."""
    mac, rest = F.regexp_extract("value", r"^([0-9A-Fa-f:.-]+)(?:/(\d+))?\s+([^#]*)", 1), F.trim(F.regexp_extract("value", r"^([0-9A-Fa-f:.-]+)(?:/(\d+))?\s+([^#]*)", 3))
    bits = F.regexp_extract("value", r"^([0-9A-Fa-f:.-]+)(?:/(\d+))?\s+([^#]*)", 2)
    digits = F.upper(F.regexp_replace(mac, "[:.-]", ""))
    return numbered(spark, path).where(mac != "").select(digits.alias("prefix"), F.when(bits != "", bits.cast("int")).otherwise(F.length(digits) * 4).alias("bits"), rest.alias("vendor"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines key=value; what follows # is a comment, of repeated keys the last counts."""
    plain = F.trim(F.regexp_replace("value", "#.*$", ""))
    out = numbered(spark, path).select("line", F.trim(F.substring_index(plain, "=", 1)).alias("key"), F.trim(plain.substr(F.instr(plain, "=") + 1, F.length(plain))).alias("value"), plain.contains("=").alias("ok"))
    return out.where("ok").groupBy("key").agg(F.max_by("value", "line").alias("value"))


#: Letters of quirks and their bits.
QUIRKS = {"P": 1, "Z": 2, "I": 4, "U": 8, "X": 16, "A": 32, "T": 64, "F": 128, "D": 256, "!": 512, "K": 1024, "Q": 2048, "0": 4096, "N": 8192, "L": 16384}

#: Letters of TCP options and their numbers.
OPTIONS = {"E": 0, "N": 1, "M": 2, "W": 3, "S": 4, "T": 8}


def quirk_bits(letters: Column) -> Column:
    """The bits of a text of quirk letters; "." is none."""
    out = F.lit(0)
    for letter, bit in QUIRKS.items():
        out = out.bitwiseOR(F.when(letters.contains(letter), bit).otherwise(0))
    return out


def os_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Operating-system signatures of a file: parsed_systems() of its lines."""
    return parsed_systems(numbered(spark, path))


def parsed_systems(lines: DataFrame) -> DataFrame:
    """Operating-system signatures of lines window:ttl:df:size:options:quirks:genre:detail.

    sig_id (from 0); win_mode (any, value, modulo, mss, mtu) and win; ttl; df; size (0: 100 or
    more); opts (numbers of the options); mss and wscale, and whether each is a modulus;
    zero_stamp (no time stamp, or one of value 0); quirks (bits); userland, no_detail, generic; genre; detail.
    """
    p = F.split("value", ":", 8)
    window, options, genre = F.element_at(p, 1), F.element_at(p, 5), F.element_at(p, 7)
    mode = F.when(window == "*", "any").when(window.startswith("%"), "modulo").when(window.startswith("S"), "mss").when(window.startswith("T"), "mtu").otherwise("value")
    listed = F.filter(F.split(options, ","), lambda o: (o != "") & (o != "."))

    def option(o: Column) -> Column:
        out = F.regexp_extract(o, r"\?(\d+)", 1)
        code = F.when(out != "", out.cast("int"))
        for letter, kind in OPTIONS.items():
            code = F.when(o.startswith(letter), F.lit(kind)).otherwise(code)
        return code

    def number(letter: str) -> list[Column]:
        """The value of an option, and whether it is a modulus ("*" is modulus 1); 0 without the option."""
        found, modulus = F.regexp_extract(options, rf"(?:^|,){letter}%?(\d+)", 1), options.rlike(rf"(?:^|,){letter}%")
        some = options.rlike(rf"(?:^|,){letter}\*")
        return [F.when(some, 1).when(found != "", found.try_cast("int")).otherwise(0), some | modulus]

    (mss, mss_mod), (wscale, wscale_mod) = number("M"), number("W")
    flagged = F.regexp_extract(genre, "^([-*@]*)(.*)$", 1)
    out = lines.where(F.size(p) == 8).select(
        "line", mode.alias("win_mode"), F.coalesce(F.regexp_extract(window, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("win"),
        F.element_at(p, 2).try_cast("int").alias("ttl"), F.element_at(p, 3).try_cast("int").alias("df"), F.coalesce(F.element_at(p, 4).try_cast("int"), F.lit(0)).alias("size"),
        F.transform(listed, option).alias("opts"), mss.alias("mss"), mss_mod.alias("mss_mod"), wscale.alias("wscale"), wscale_mod.alias("wscale_mod"),
        (~F.exists(listed, lambda o: o == "T")).alias("zero_stamp"), quirk_bits(F.element_at(p, 6)).alias("quirks"),
        flagged.contains("-").alias("userland"), flagged.contains("*").alias("no_detail"), flagged.contains("@").alias("generic"),
        F.regexp_extract(genre, "^([-*@]*)(.*)$", 2).alias("genre"), F.element_at(p, 8).alias("detail"),
    )
    return out.withColumn("sig_id", F.row_number().over(by_line()) - 1).drop("line")
