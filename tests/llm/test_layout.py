"""Sharding, WARC, ranks and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from cases import CLASHING, awkward_rows, documents, ordered, prose
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.functions.folders import new_folder
from millrace.llm.ranks import with_rank
from millrace.llm.shards import interleaved_shards
from millrace.llm.warc import closing_member, member, read_members, read_record, read_warc, write_warc


def test_ranks_are_gapless_and_in_order(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 400, 'hot', if(id < 410, null, string(id % 7))) key", "'clash' rank0")
    by_hash = with_rank(df, ["key"], ["id"], "rank").collect()
    in_order = with_rank(df, ["key"], ["id"], "rank", "cast(id div 50 as int)").collect()
    for rows in (by_hash, in_order):
        groups = {}
        for row in rows:
            groups.setdefault(row.key, []).append((row.rank, row.id))
        assert sum(map(len, groups.values())) == 1000
        assert all([rank for rank, _ in sorted(held)] == list(range(len(held))) for held in groups.values())
    for key in {row.key for row in in_order}:
        held = sorted((row.rank, row.id) for row in in_order if row.key == key)
        assert [i for _, i in held] == sorted(i for _, i in held)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_match_the_mixture(spark, shards):
    rows = [(k, f"text {k}", "en", "hot" if k % 3 == 0 else f"s{k % 40}", 0) for k in range(900)] + awkward_rows()
    placed = interleaved_shards(documents(spark, rows, clashing=True), shards).collect()
    text_of = {(row[0], len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode())): row for row in rows}
    assert len(placed) == len(rows)
    slots, mixture = {}, {}
    for row in placed:
        slots.setdefault(row.shard, []).append(row.slot)
        source = text_of[row.doc_id, row["size"], row.text_crc32][3]
        mixture.setdefault(source, dict.fromkeys(range(shards), 0))[row.shard] += 1
    assert sorted(slots) == list(range(shards))
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(max(held.values()) - min(held.values()) <= 5 for held in mixture.values())


def test_shards_by_sorting(spark):
    """The order by fractional rank, made anew: rows ranked in their source, moved by its phase, sorted and cut."""
    rows = [(k, f"text {k}", "en", "hot" if k % 3 == 0 else f"s{k % 9}", 0) for k in range(300)] + awkward_rows()
    df = documents(spark, rows)
    hashed = df.select(
        "doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(7), "doc_id").alias("shuffled"),
        F.pmod(F.xxhash64(F.lit(7), F.lit("phase"), "source"), F.lit(1 << 20)).alias("phase"),
    ).collect()
    least = -(1 << 70)
    known = [
        (row.source, row.shuffled, row.doc_id, zlib.crc32(row.text.encode()), len(row.text.encode()) + 1, row.phase / (1 << 20)) for row in hashed
    ]
    by_source = {}
    for row in known:
        by_source.setdefault(row[0], []).append((row[1], least if row[2] is None else row[2], *row[3:]))
    order = []
    for source, held in by_source.items():
        for rank, row in enumerate(sorted(held)):
            order.append(((rank + row[4]) / len(held), source or "", *row[:4]))
    order.sort()
    wanted, seen = [], {}
    for place, (_, _, _, row, crc, size) in enumerate(order):
        shard = place * 16 // len(order)
        wanted.append((None if row == least else row, size, crc, shard, seen.setdefault(shard, 0)))
        seen[shard] += 1
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in interleaved_shards(df).collect()]
    assert ordered(got) == ordered(wanted)


def test_shards_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k, str(k), "en", f"s{k % 5}", 0) for k in range(300)]
    shuffled = random.Random(1).sample(rows, 300)
    assert ordered(interleaved_shards(documents(spark, rows)).collect()) == ordered(interleaved_shards(documents(spark, shuffled)).collect())
    assert interleaved_shards(documents(spark, [])).count() == 0


PAGES = "page_id bigint, url string, html string"


def page_rows():
    noise = "".join(random.Random(1).choices("abcdefghij", k=300_000))
    return [
        (1, "u", None), (2, None, ""), (3, "a\r\nb: c", "y" * 1000), (4, "q", "y" * 1000), (None, "q", "y" * 1000), (5, "z", "y" * 999),
        (6, "z", "y" * 999), (7, "b", noise), (8, "c", noise), (9, "é ü", "ü" * 500), (9, "é ü", "ü" * 500), (10, "", "\r\n\r\n" * 300),
    ]


def wanted_records(rows):
    largest = {}
    for page, _, html in rows:
        largest[html] = max(page or -1, largest.get(html, -1))
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 1000 and largest[html] != page
        yield page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None


def test_archives_come_back(spark):
    rows, folder = page_rows(), new_folder(spark, "warc")
    write_warc(spark.createDataFrame(rows, PAGES).withColumns({name: F.lit(1) for name in CLASHING}), folder)
    found = read_warc(spark, folder).collect()
    assert ordered((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == ordered(wanted_records(rows))
    html = {page: (text or "").encode() for page, _, text in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in found)
    assert all(bytes(r.payload) == html[r.page_id] for r in found if r.payload is not None)


def test_query_against_its_sql(spark, tmp_path):
    from oracle import differences, sql_connection

    import __spark_entry__

    spark.createDataFrame(page_rows(), PAGES).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = sql_connection("/root/testdata/sf0.001")
    query = __spark_entry__.queries()["op4_warc"]
    assert differences(query(spark, "/root/testdata/sf0.001"), __spark_entry__.oracle_sql()["op4_warc"], connection) == ""
    connection.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert differences(query(spark, str(tmp_path)), __spark_entry__.oracle_sql()["op4_warc"], connection) == ""


def test_files_are_nothing_but_members(spark):
    folder = new_folder(spark, "warc")
    write_warc(spark.createDataFrame(page_rows(), PAGES), folder)
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
    members = [m for content in contents for m in read_members(content)]
    assert sum(m.startswith(b"WARC/1.1\r\n") for m in members) == len(members) == len(page_rows())


def test_large_records_end_in_a_zero_as_well(spark, monkeypatch):
    assert closing_member()[-1] == 0
    big = member([("WARC-Type", "response")], b"x" * (1 << 24))
    assert big[-1] == 1
    from millrace.llm.warc import chunk

    held = chunk([big]) + b"\0"
    assert len(list(read_members(held))) == 2


def test_damage_is_an_error():
    record = member([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Block-Digest", "sha1:0")], b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        read_record(next(read_members(record)))
    with pytest.raises(ValueError, match="ends within"):
        list(read_members(record[:-9]))
    with pytest.raises(zlib.error):
        list(read_members(record[:-8] + b"\1" * 8))
    with pytest.raises(ValueError, match="Content-Length"):
        read_record(b"WARC/1.1\r\nWARC-Record-ID: <r>\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError, match="begin with a record"):
        read_record(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="no type"):
        read_record(b"WARC/1.0\r\nWARC-Record-ID: <r>\r\n\r\n")
    with pytest.raises(ValueError, match="ends within the record"):
        list(read_members(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n"))


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"


def foreign(kind, block, fields=(), version="WARC/1.0", name="<urn:uuid:1>", end="\r\n"):
    """A record as other writers make it."""
    lines = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def foreign_records():
    page, chunked = HTTP + b"Content-Length: 5\r\n\r\nhello", HTTP + b"Transfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    http = ["Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/"]
    return [
        foreign("warcinfo", b"software: other\r\n", ["Content-Type: application/warc-fields"]),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", ["Content-Type: application/http; msgtype=request"]),
        foreign("response", page, [*http, f"WARC-Payload-Digest: {base32(b'hello')}", f"WARC-Block-Digest: {base32(page)}"]),
        foreign("response", page, [*http, f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'hello').hexdigest()}"], "WARC/1.1"),
        foreign("response", page, ["content-type:application/http;msgtype=response", "WARC-Target-URI:  http://b/\r\n  folded"]),
        foreign("response", chunked, http),
        foreign("response", HTTP + b"\r\nno length", [*http, "WARC-Payload-Digest: blake9:unknown"]),
        foreign("response", HTTP + b"Content-Length: 99\r\n\r\ncut", [*http, "WARC-Truncated: length"]),
        foreign("revisit", HTTP + b"Content-Length: 5\r\n\r\n", [*http, f"WARC-Payload-Digest: {base32(b'hello')}", "WARC-Refers-To: <urn:uuid:0>"]),
        foreign("resource", b"\x00\xff plain", ["Content-Type: image/png"]),
        foreign("metadata", b"a: b", ["Content-Type: application/warc-fields"]),
        foreign("conversion", b"text", ["Content-Type: text/plain"], "WARC/1.1"),
    ]


@pytest.mark.parametrize("form", ["members", "plain", "mixed"])
def test_archives_of_other_writers(spark, tmp_path, form):
    records = foreign_records()
    packed = [record if form == "plain" or (form == "mixed" and k % 2) else gzip.compress(record) for k, record in enumerate(records)]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(packed))
    found = read_warc(spark, str(tmp_path), types=None).collect()
    kinds = ["warcinfo", "request", *["response"] * 6, "revisit", "resource", "metadata", "conversion"]
    assert [row.record_type for row in found] == kinds
    assert {row.page_id for row in found} == {None} and {row.record_id for row in found} == {"<urn:uuid:1>"}
    assert [row.payload and bytes(row.payload) for row in found[2:10]] == [
        b"hello", b"hello", b"hello", b"5\r\nhello\r\n0\r\n\r\n", b"no length", b"cut", None, b"\x00\xff plain",
    ]
    sha1 = hashlib.sha1(b"hello").hexdigest()
    assert [row.payload_digest for row in found[2:9]] == [sha1, hashlib.sha256(b"hello").hexdigest(), None, None, "unknown", None, sha1]
    assert found[8].payload_bytes == 5 and found[4].url == "http://b/ folded"
    pages = read_warc(spark, str(tmp_path)).collect()
    assert len(pages) == 7


def test_wrong_digests_of_other_writers():
    page = HTTP + b"Content-Length: 5\r\n\r\nhello"
    for digest in (base32(b"other"), "sha1:not base32!", "md5:00"):
        with pytest.raises(ValueError, match="differs"):
            read_record(foreign("response", page, ["Content-Type: application/http", f"WARC-Payload-Digest: {digest}"]))
        with pytest.raises(ValueError, match="differs"):
            read_record(foreign("response", page, [f"WARC-Block-Digest: {digest}"]))


def test_any_bytes_pass_the_text_sink(spark):
    """Members are written as text; Spark must neither check nor change the bytes."""
    folder, every = new_folder(spark, "bytes"), bytes(range(1, 256)) * 40
    rows = spark.createDataFrame([(every,), (bytes(reversed(every)),)], "b binary").coalesce(1)
    rows.select(F.col("b").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    assert bytes(spark.read.format("binaryFile").load(folder).first().content) == every + b"\0" + bytes(reversed(every)) + b"\0"


def test_no_pages(spark):
    folder = new_folder(spark, "warc")
    write_warc(spark.createDataFrame([], PAGES), folder)
    assert read_warc(spark, folder).count() == 0


def pipeline_rows():
    """Prose, junk, short texts, toxic texts, near copies and passages that many share."""
    rows, passage = [], prose(77, 70)
    for k in range(160):
        text = prose(1000 + k, 90 + k)
        if k % 8 == 0:
            text = text.replace(" ", " vile ", 4)
        if k % 5 == 1:
            text += "\n" + passage
        rows.append((k, text, "en", "s", len(text)))
    rows += [(300 + k, rows[3][1], "en", "s", 1) for k in range(4)] + [(310, rows[9][1], "en", "s", 1), (311, "few words", "en", "s", 9)]
    rows += [(320, " ".join(f"{w.upper()}%%%" for w in prose(5, 200).split()), "en", "s", 1), (330, None, None, None, None), (331, "", "en", "s", 0)]
    return rows


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = pipeline_rows()
    documents(spark, rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k % 8 == 0)) for k in range(160)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    text = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        ids[name] = sorted({row.doc_id for row in docs.collect()})
        if number < 4:
            assert docs.columns == columns
            assert docs.where(" or ".join(f"`{name}` <> 'clash'" for name in CLASHING)).count() == 0
            assert docs.where("n_chars <> char_length(text)").count() == 0 or number < 3
            text[name] = {row.doc_id: row.text for row in docs.collect()}
    assert ids["quality rules"] == [*range(160), 300, 301, 302, 303, 310]
    toxic = set(ids["quality rules"]) - set(ids["toxicity"])
    assert toxic <= set(range(0, 160, 8)) and len(toxic) >= 8
    assert not set(ids["simhash near-dedup"]) & {300, 301, 302, 303, 310} and len(ids["simhash near-dedup"]) == len(ids["toxicity"]) - 5
    assert ids["suffix-array dedup"] == ids["simhash near-dedup"] == ids["packing"]
    from test_dedup import brute_repeats

    wanted = brute_repeats(sorted((doc, held.encode()) for doc, held in text["simhash near-dedup"].items()))
    assert text["suffix-array dedup"] == {doc: kept.decode("utf-8", "ignore") for doc, *_, kept in wanted}
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(row.n == row["all"] for row in packed)


def test_pipeline_as_one_query(spark, tmp_path):
    documents(spark, pipeline_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 160


def test_pipeline_on_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
