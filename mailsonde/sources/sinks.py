"""Exports: partitioned tables, CSV, JSON, STIX, MISP, HTML. Rows are shaped in Spark; only bounded reports meet the driver."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import overview

STIX_NAMESPACE = "mailsonde"


def write_partition(df: DataFrame, path: str, analysis_id: str) -> None:
    """One analysis's rows; a second write of it replaces the first and leaves others alone."""
    out = df.withColumn("analysis_id", F.lit(analysis_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def read_partition(spark, path: str, analysis_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("analysis_id") == analysis_id)


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    sorted_json(df).write.mode("overwrite").text(path)


def flat(sessions: DataFrame) -> DataFrame:
    """Nested columns as text, arrays as their sizes: what a CSV can hold."""
    cols: list[Column] = []
    for f in sessions.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            cols.append(F.coalesce(F.size(f.name), F.lit(0)).alias(f"{f.name}_count"))
        elif kind == "struct":
            cols += [F.col(f"{f.name}.{g.name}").cast("string").alias(f"{f.name}_{g.name}") for g in f.dataType.fields if g.dataType.typeName() not in ("array", "struct", "map")]
        elif kind == "map":
            cols.append(F.to_json(f.name).alias(f.name))
        elif kind == "binary":
            cols.append(F.lower(F.hex(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return sessions.select(*cols)


def write_csv(sessions: DataFrame, path: str) -> None:
    flat(sessions).write.mode("overwrite").option("header", True).csv(path)


def _uuid(*parts: Column) -> Column:
    """A version-5-shaped id from a hash of the parts."""
    h = F.sha1(F.concat_ws("|", F.lit(STIX_NAMESPACE), *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix_objects(sessions: DataFrame, risky: int = 60) -> DataFrame:
    """(id, object): the addresses and traffic of each session, an indicator and a relationship where it is risky."""
    ident = lambda kind, *p: F.concat(F.lit(f"{kind}--"), _uuid(F.lit(kind), *p))
    text = lambda c: F.col(c).cast("string")
    src, dst = ident("ipv4-addr", text("client_ip")), ident("ipv4-addr", text("server_ip"))
    traffic, indicator = ident("network-traffic", text("id")), ident("indicator", text("id"))
    when = F.date_format(F.timestamp_seconds("first_seen"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    address = lambda c, i: F.struct(i.alias("id"), F.to_json(F.struct(F.lit("ipv4-addr").alias("type"), F.lit("2.1").alias("spec_version"), i.alias("id"), text(c).alias("value"))).alias("object"))
    t = F.struct(traffic.alias("id"), F.to_json(F.struct(F.lit("network-traffic").alias("type"), F.lit("2.1").alias("spec_version"), traffic.alias("id"), src.alias("src_ref"), dst.alias("dst_ref"), F.col("server_port").alias("dst_port"), F.array(F.lit("tcp"), F.lower("protocol")).alias("protocols"))).alias("object"))
    pattern = F.format_string("[ipv4-addr:value = '%s']", text("server_ip"))
    i = F.struct(indicator.alias("id"), F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), indicator.alias("id"), when.alias("created"), when.alias("modified"), when.alias("valid_from"), F.lit("stix").alias("pattern_type"), pattern.alias("pattern"))).alias("object"))
    link = ident("relationship", text("id"))
    r = F.struct(link.alias("id"), F.to_json(F.struct(F.lit("relationship").alias("type"), F.lit("2.1").alias("spec_version"), link.alias("id"), when.alias("created"), when.alias("modified"), F.lit("based-on").alias("relationship_type"), indicator.alias("source_ref"), traffic.alias("target_ref"))).alias("object"))
    objects = F.concat(F.array(address("client_ip", src), address("server_ip", dst), t), F.when(F.col("risk_score") >= risky, F.array(i, r)).otherwise(F.array().cast("array<struct<id:string,object:string>>")))
    return sessions.select(F.explode(objects).alias("o")).select("o.id", "o.object").dropDuplicates(["id"])


def misp_attributes(sessions: DataFrame) -> DataFrame:
    """Distinct (type, category, value, to_ids) of addresses, server names and fingerprints; risky sessions mark them."""
    mark = F.max(F.col("risk_score") >= 60).alias("to_ids")
    parts = [("ip-src", "Network activity", "client_ip"), ("ip-dst", "Network activity", "server_ip"), ("hostname", "Network activity", "sni"), ("ja3-fingerprint-md5", "Network activity", "ja3")]
    each = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(c).alias("category"), F.col(v).cast("string").alias("value")) for k, c, v in parts])
    rows = sessions.select("risk_score", F.explode(each).alias("a")).select("risk_score", "a.*").where("value <> ''")
    return rows.groupBy("type", "category", "value").agg(mark)


def html_report(sessions: DataFrame, findings: DataFrame, title: str = "Mail transport analysis") -> str:
    """A bounded page: key figures, bands, sentences and the five most frequent findings."""
    esc = lambda x: html.escape(str(x))
    table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    k = overview.kpis(sessions).first()
    bands = overview.band_histogram(sessions).collect()  # five rows
    says = overview.takeaways(sessions).orderBy("position").collect()  # four rows at most
    top = overview.top_remediations(findings).collect()  # five rows at most
    body = [f"<h1>{esc(title)}</h1>", table(k.asDict().items()), "<h2>Bands</h2>", table(bands), "<h2>Findings</h2>", table(top), *[f"<p>{esc(r['sentence'])}</p>" for r in says]]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body>{''.join(body)}</body></html>"


def write_captures(packets: DataFrame, path: str, key: str = "capture_id", link: int = 101, most: int = 64 << 20) -> DataFrame:
    """Packets (PACKETS) as classic capture files under path; (file, packets, bytes) of each, settled.

    A key's packets stay in one file, in order of their numbers; files are closed beyond `most` bytes, at a key's end.
    File names hold the attempt, and only files of attempts that counted are returned, so a task that ran twice leaves
    files that nobody reads. Payloads begin at the network header, which is link type 101; tags are not written. Times
    are kept to the microsecond. No packets: no files. path must be one that pyarrow opens.
    """
    import struct
    import uuid

    import pyarrow as pa

    from .ranges import opened
    from .trust import settled

    def run(batches):
        fs, base = opened(path)
        fs.create_dir(base, recursive=True)
        rows, parts, size, n, last = [], [], 0, 0, object()

        def close():
            name = f"{uuid.uuid4().hex}.pcap"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, link))
                for x in parts:
                    out.write(x)
            rows.append((f"{path.rstrip('/')}/{name}", n, size + 24))

        for b in batches:
            for k, ts, wire, data in zip(*(b.column(c) for c in ("k", "ts", "wirelen", "payload")), strict=True):
                if (k := k.as_py()) != last and size >= most:
                    close()
                    parts, size, n = [], 0, 0
                last, us, data = k, round(ts.as_py() * 1e6), data.as_py()
                parts += [struct.pack("<IIII", us // 10**6, us % 10**6, len(data), max(len(data), wire.as_py())), data]
                size, n = size + 16 + len(data), n + 1
        if n:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["file", "packets", "bytes"])

    ordered = packets.select(F.col(key).alias("k"), "index", "ts", "wirelen", "payload").repartition("k").sortWithinPartitions("k", "index")
    return settled(ordered.mapInArrow(run, "file string, packets long, bytes long"), "capture-files")
