"""Readers and writers of the domain's files. Malformed rows are skipped, defaulted or an error, as each format asks for."""

from __future__ import annotations

import functools
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.address import dialable, parse_hex
from tesserae.operators.rank import keep_first
from tesserae.session import settled

TOPOLOGY = "overlay_hex string, dialed_ok string, rtt_ms string, last_seen_ms string, underlays string"
PEER_STATE = "overlay_hex string, threshold_last string, lambda_ms string, settled_units string, last_ok_unix string, service_cps_x10 string, surplus_units string"
#: Rows of a file where a table is written in parts, so that no later task reads more at once.
PART_ROWS = 500_000
#: The first line of a resume sidecar, where the caller gives no other.
SIDECAR_MAGIC = "resume-state v1"
#: White space of JSON.
_BLANKS = " \t\r\n"


def _number(c: str, kind: str = "bigint") -> Column:
    return F.trim(F.col(c)).try_cast(kind)


def read_chunks(spark: SparkSession, path: str, most: int | None = None, strict: bool = False) -> DataFrame:
    """Chunk inventory by header name. A row without a valid address is skipped, or an error where strict. most: the first so many in file order."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    place = F.monotonically_increasing_id()  # in one file the order of its lines
    out = raw.select(place.alias("line"), F.col("address_hex"), parse_hex("address_hex").alias("address"), *(F.col(c) for c in raw.columns if c not in ("address_hex", "line", "address")))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an address: "), F.coalesce("address_hex", F.lit("")))).cast("string")
        out = out.withColumn("address", F.when(F.col("address").isNull(), bad).otherwise(F.col("address")))
    else:
        out = out.where(F.col("address").isNotNull())
    out = out.drop("address_hex")
    return (out if most is None else out.orderBy("line").limit(most)).drop("line")


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """Node records by position; a round trip that can't be read is unknown, a time is 0, addresses are split on bars. seq is the order of lines."""
    raw = spark.read.schema(TOPOLOGY).option("header", True).csv(path)
    return raw.select(
        parse_hex("overlay_hex").alias("overlay"),
        (F.col("dialed_ok") == "1").alias("dialed_ok"),
        _number("rtt_ms", "int").alias("rtt_ms"),
        F.coalesce(_number("last_seen_ms"), F.lit(0)).alias("tick"),
        F.split(F.coalesce("underlays", F.lit("")), "[|]").alias("underlays"),
        F.monotonically_increasing_id().alias("seq"),
    ).where("overlay is not null")


def write_topology(nodes: DataFrame, path: str) -> None:
    """K1/K3: the whole table, sorted by overlay."""
    out = nodes.select(
        F.col("overlay").alias("overlay_hex"), F.col("dialed_ok").cast("int").cast("string").alias("dialed_ok"), F.coalesce(F.col("rtt_ms").cast("string"), F.lit("")).alias("rtt_ms"),
        F.col("last_seen_ms").cast("string").alias("last_seen_ms"), F.concat_ws("|", "underlays").alias("underlays"),
    )
    out.repartitionByRange("overlay_hex").sortWithinPartitions("overlay_hex").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_seeds(spark: SparkSession, path: str, most: int, given: list[str] | None = None) -> DataFrame:
    """S3: an explicit list, or else the first dialable address of the rows that could be dialled, in file order."""
    if given:
        return spark.createDataFrame([(u,) for u in given], "underlay string")
    raw = spark.read.option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    if "dial_ok" in raw.columns:
        raw = raw.where("dial_ok = '1'")
    first = F.get(F.filter(F.split("underlay", "[|]"), dialable), 0)
    return raw.select("line", first.alias("underlay")).where("underlay is not null").orderBy("line").limit(most).select("underlay")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Dialled rows, the first of each overlay, with an address."""
    raw = spark.read.option("header", True).csv(path)
    if missing := {"overlay_hex", "underlay", "dial_ok"} - set(raw.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    good = F.filter(F.split("underlay", "[|]"), lambda u: u.startswith("/"))
    rows = raw.withColumn("line", F.monotonically_increasing_id()).where("dial_ok = '1'").select("line", parse_hex("overlay_hex").alias("overlay"), good.alias("underlays"))
    return keep_first(rows.where("overlay is not null"), "overlay", ["line"]).where(F.size("underlays") > 0).select("overlay", "underlays")


def read_peer_state(spark: SparkSession, path: str) -> DataFrame:
    """Short rows are skipped, missing trailing columns are 0, a later row of an overlay wins."""
    raw = spark.read.schema(PEER_STATE).option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    rows = raw.where(F.col("last_ok_unix").isNotNull()).select(
        "line", parse_hex("overlay_hex").alias("overlay"), *[F.coalesce(_number(c), F.lit(0)).alias(c) for c in ("threshold_last", "settled_units", "last_ok_unix", "service_cps_x10", "surplus_units")], _number("lambda_ms").alias("lambda_ms"),
    )
    return keep_first(rows.where("overlay is not null"), "overlay", [F.desc("line")]).drop("line")


def write_peer_state(state: DataFrame, path: str) -> None:
    """K5: whole-file rewrite; only a committed job is seen."""
    cols = [c.split()[0] for c in PEER_STATE.split(", ")]
    text = [F.coalesce(F.col("overlay" if c == "overlay_hex" else c).cast("string"), F.lit("")).alias(c) for c in cols]
    state.select(*text).orderBy("overlay_hex").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def ledger_entries(lines: DataFrame, ours: str) -> DataFrame:
    """(beneficiary, amount) from lines of JSON objects (path, n, of, line, journal), closed to anything it doesn't know.

    A key is a beneficiary, or section and beneficiary, of 40 hexadecimal digits each; the section
    must be ours. An amount is decimal digits. Commit marks (#n) are skipped. The last line of a
    journal may be torn; any other that can't be read is an error.
    """
    err = lambda what, c: F.raise_error(F.concat(F.lit(what + ": "), c))
    text = F.trim(F.col("line"))
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    usable = F.try_parse_json(text).isNotNull() & text.startswith("{")
    torn = F.col("journal") & (F.col("n") == F.col("of")) & ~usable
    skipped = (text == "") | text.rlike("^#[0-9]+$") | torn
    fine = usable & ~F.col("line").contains("\0")
    # most lines are one entry without a blank, which needs no parser; any other line takes the general way
    plain = text.rlike(rf'^\{{"(?:(?i:{re.escape(ours)}):)?[0-9a-fA-F]{{40}}":"[0-9]{{1,78}}"\}}\z')
    at = F.when(F.substring(text, 43, 1) == ":", 44).otherwise(3)
    entry = F.create_map(F.substring(text, at, F.lit(40)), F.substring(text, at + 43, F.length(text) - at - 44))
    # one expression, as a filter on the map would be evaluated in any order with others
    general = F.when(skipped, F.create_map().cast("map<string,string>")).when(fine, parsed).otherwise(err("not a ledger line", F.col("path")).cast("map<string,string>"))
    rows = lines.select(plain.alias("plain"), F.when(plain, entry).otherwise(general).alias("map"))
    # of a plain explode Spark makes a filter that parses every line once more
    kv = rows.select("plain", F.explode_outer("map").alias("key", "amount")).where(F.col("key").isNotNull())
    bare, sectioned = F.col("key").rlike("^[0-9a-fA-F]{40}$"), F.col("key").rlike("^[0-9a-fA-F]{40}:[0-9a-fA-F]{40}$")
    own = F.lower(F.substring("key", 1, 40)) == ours.lower()
    name = F.when(F.col("plain") | bare, F.col("key")).when(sectioned & own, F.substring("key", 42, 40)).when(sectioned, err("foreign section", F.col("key")).cast("string")).otherwise(err("unknown key", F.col("key")).cast("string"))
    amount = F.when(F.col("plain") | F.col("amount").rlike("^[0-9]{1,78}$"), F.col("amount")).otherwise(err("not an amount", F.coalesce("amount", F.lit("null"))).cast("string"))
    return kv.select(F.lower(name).alias("beneficiary"), amount.alias("amount"))


def write_ledger(entries: DataFrame, path: str) -> None:
    """K5: a ledger's base of (key, amount), each key once: one object, an entry to a line, sorted; the files of the folder are its parts in order of their names."""
    entries = settled(entries)
    first, last = entries.agg(F.min("key"), F.max("key")).first()
    if first is None:
        put_text(entries.sparkSession, f"{path}/part-00000", "{\n}")
        return
    before, after = F.when(F.col("key") == first, "{\n").otherwise(""), F.when(F.col("key") == last, "\n}").otherwise(",")
    line = F.concat(before, F.lit('  "'), "key", F.lit('": "'), "amount", F.lit('"'), after)
    entries.repartitionByRange("key").sortWithinPartitions("key").select(line).write.option("lineSep", "\n").text(path)


def write_journal(lines: DataFrame, path: str, torn: str = "") -> None:
    """A ledger's journal of (line); torn: a last line that was cut off, so no newline follows it."""
    lines.select("line").write.option("lineSep", "\n").text(path)
    if torn:
        put_text(lines.sparkSession, f"{path}/torn", torn)  # by its name after all parts


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with just this text."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, False)
    out.write(bytearray(text.encode()))
    out.close()


def _pieces(spark: SparkSession, path: str, separator: str, file: str | None = None) -> DataFrame:
    """Text between separators, with the file (of a folder the files are parts in order of their names), its size and the place in it. file: only what this one has."""
    raw = spark.read.option("lineSep", separator).text(path)
    if file is not None:  # before the place, which nothing is pushed below: no other file is opened
        raw = raw.where(F.col("_metadata.file_name") == file)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # a block is read in one go
    return raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), place.alias("place"))


def _ended() -> Column:
    """Whether the pieces of a file are all followed by a separator, the last one too."""
    return (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("ended")


def _base_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a base, each as an object of its own. No sound entry holds a comma or a brace, so files of any size are read in parallel by commas; then what lies around the entries must be one object's."""
    inner = F.btrim(F.regexp_replace(F.btrim("value", F.lit(_BLANKS)), r"^\{|\}$", ""), F.lit(_BLANKS))
    pieces = _pieces(spark, path, ",").withColumn("inner", inner)
    end, number = lambda f: F.btrim(f("value", "place"), F.lit(_BLANKS)), lambda c: F.sum(F.length("value") - F.length(F.replace("value", F.lit(c), F.lit(""))))
    parts = pieces.groupBy("file").agg(
        end(F.min_by).alias("head"), end(F.max_by).alias("tail"), F.count("*").alias("n"), F.count_if(F.col("inner") == "").alias("blank"), number("{").alias("opens"), number("}").alias("closes"), _ended(),
    )
    parts = sorted(parts.collect(), key=lambda r: r.file)
    sound = parts and sum(r.opens for r in parts) == sum(r.closes for r in parts) == 1 and parts[0].head.startswith("{") and parts[-1].tail.endswith("}") and not parts[-1].ended
    # a comma stands between two entries, also where a part ends, and nowhere else
    sound = sound and (sum(r.n for r in parts) == 1 or not parts[-1].blank and all(r.blank == (not r.ended) and (r.ended or not r.tail) for r in parts[:-1]))
    if not sound:
        raise ValueError(f"{path} isn't one object of entries")
    lines = pieces.where("inner <> ''").select(F.concat(F.lit("{"), "inner", F.lit("}")).alias("line"))
    return lines.select("line", F.lit(0).alias("n"), F.lit(1).alias("of"), F.lit(path).alias("path"), F.lit(False).alias("journal"))


def _journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a journal; n = of marks the last one if no newline follows it, which may be torn."""
    lines = _pieces(spark, path, "\n")
    last = max((unquote(f.rsplit("/", 1)[1]) for f in lines.inputFiles()), default=None)
    own = _pieces(spark, path, "\n", last)
    end = own.agg(F.max_by("value", "place").alias("line"), _ended()).first() if last else None
    torn = F.lit(False)
    # a line like it that stands before it is damage
    if end and end.ended is False and own.where(F.col("value") == end.line).count() == 1:
        torn = (F.col("file") == last) & (F.col("value") == end.line)
    return lines.select(F.col("value").alias("line"), torn.cast("int").alias("n"), F.lit(1).alias("of"), F.lit(path).alias("path"), F.lit(True).alias("journal"))


def read_ledger(spark: SparkSession, base: str, ours: str) -> DataFrame:
    """A ledger's base file with its journals beside it, merged; a missing file is empty, a .lost marker an error. Each is a file, or a folder of its parts."""
    from tesserae.operators.aggregates import ledger_merge

    there = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if there(base + ".lost"):
        raise ValueError(f"{base} is marked lost")
    found = [(_journal_lines if suffix else _base_lines)(spark, base + suffix) for suffix in ("", ".journal.old", ".journal") if there(base + suffix)]
    if not found:
        return spark.createDataFrame([], "beneficiary string, amount string")
    return ledger_merge(ledger_entries(functools.reduce(DataFrame.union, found), ours))


def read_chunk_index(spark: SparkSession, path: str, magic: str, data_end: int) -> DataFrame:
    """Entries of a chunk store's index that lie within its data; of a file without the magic line nothing."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l")).where(F.get("l", 0) == f"{magic} v1")
    p = F.split("line", ",")
    rows = whole.select(F.explode(F.slice("l", 3, F.greatest(F.lit(0), F.size("l") - 2))).alias("line"))
    rows = rows.where(F.size(p) == 3).select(parse_hex(F.get(p, 0)).alias("address"), F.get(p, 1).try_cast("bigint").alias("offset"), F.get(p, 2).try_cast("int").alias("len"))
    return rows.where((F.col("address").isNotNull()) & (F.col("offset") >= 0) & (F.col("len") >= 0) & (F.col("offset") + F.col("len") <= data_end))


def sidecar_text(root: Column, offset: Column, magic: str = SIDECAR_MAGIC) -> Column:
    """P25."""
    return F.concat(F.lit(magic + "\nroot="), root, F.lit("\noffset="), offset.cast("string"))


def parse_sidecar(text: Column, magic: str = SIDECAR_MAGIC) -> Column:
    """Struct of root and offset, NULL for anything that isn't exactly such a text."""
    form = f"^{re.escape(magic)}\nroot=([0-9a-fA-F]{{64}})\noffset=([0-9]{{1,19}})\n?$"
    at = F.regexp_extract(text, form, 2).try_cast("bigint")
    return F.when(text.rlike(form) & at.isNotNull(), F.struct(F.lower(F.regexp_extract(text, form, 1)).alias("root"), at.alias("offset")))


def split_payload(files: DataFrame, size: int = 4096) -> DataFrame:
    """(path, index, data) of each fixed-size part of binary files (path, content)."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    parts = files.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    return parts.select("path", F.col("index").cast("long").alias("index"), F.substring(F.col("content"), F.col("index") * size + 1, F.lit(size)).alias("data"))


def write_parts(rows: DataFrame, path: str, parts: int, most: int = PART_ROWS) -> int:
    """Writes rows to Parquet as they lie, in files of at most ``most`` rows and of at most a part of all; returns how many files make a part."""
    size = max(1, min(-(-rows.count() // parts), most))
    rows.write.option("maxRecordsPerFile", size).parquet(path)
    return -(-max(1, len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())) // parts)


def append_rows(rows: DataFrame, path: str) -> None:
    """K2: appends measurement rows; Parquet carries the header."""
    rows.write.mode("append").parquet(path)


def write_registry(registry: DataFrame, path: str, key: str = "overlay") -> None:
    """K4: sorted by overlay over all files, by range, so that no task sorts everything."""
    registry.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("header", True).csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """K6: event log as lines of JSON with t_ms and ev first."""
    rest = [c for c in events.columns if c not in ("t_ms", "ev")]
    events.select("t_ms", "ev", *rest).write.mode("append").json(path)


def put(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """K7: the store with new chunks (address, data, seq); an address that is there, or came earlier, stays as it was."""
    fresh = keep_first(new, "address", ["seq"])
    return fresh if store is None else store.unionByName(fresh.join(store.select("address"), "address", "left_anti"))
