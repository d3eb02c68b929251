"""Queries on small tables of odd rows against their SQL, and their work on larger ones."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone.operators import search, similar


@pytest.fixture
def both(spark, tmp_path):
    """The rows that a query and its SQL give for some tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet", mode="overwrite")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        found = con.execute(__spark_entry__.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in df.columns]
        return Counter(str(list(r)) for r in df.collect()), Counter(str([r[k] for k in at]) for r in found.fetchall())

    return run


def test_titles_decode_what_their_sql_decodes(spark, both):
    titles = ["a &quot;b&quot; &#39;c&#39;&nbsp;d", "&amp;lt;x&gt; &amp;amp;", " a \t\r\n b\f", "a\x0bb", "", " &nbsp; ", "&amp;quot;"]
    pages = [(k, f"<head><TITLE lang=x>{t}</title>") for k, t in enumerate(titles)] + [(90, None), (91, ""), (92, "no title")]
    got, want = both("html_title", pages=spark.createDataFrame(pages, "page_id long, html string"))
    assert got == want


#: Other forms of the words asked for, texts that begin with something else than a word, repeated ids.
TEXTS = [
    (1, "license of onst"), (2, "licensable onst"), (3, "licensed, onstly onsting"), (4, "-- Licensing: the ONST. License"), (5, None), (6, ""), (7, "...right reserve"), (8, "rights, reserved token"), (9, "right reserving"),
    (10, "tokenize tokens licensable"), (11, "(tokens) licensed"), (12, "\u0130stanbul license onst"), (13, "onst"), (13, " licenses"), (14, "reserved right token licensing token"), (15, "rights a reserved"), (16, "tokened"), (17, "=onst license=onst"),
]


@pytest.mark.parametrize("name", ["search_fts", "search_scan", "search_postings", "search_phrase"])
def test_searches_find_the_words_of_their_sql(spark, both, name):
    got, want = both(name, documents=spark.createDataFrame(TEXTS, "doc_id long, text string"))
    assert got == want and want


@pytest.mark.parametrize("words_of_block", [1, 5, 1 << 20])
def test_a_word_is_one_row_of_a_block(monkeypatch, words_of_block):
    monkeypatch.setattr(search, "BLOCK_WORDS", words_of_block)
    texts = [(k, None if k % 7 == 0 else ["", "red", "the", f"w{k % 3}", "red"] * (k % 4)) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([w for _, w in texts], pa.list_(pa.string()))], ["id", "words"])
    # as Arrow hands over parts of a batch
    rows = [r for b in search._grouped([batch.slice(0, 13), batch.slice(13)]) for r in b.to_pylist()]
    got = Counter((r["word"], i, tuple(p)) for r in rows for i, p in zip(r["ids"], r["positions"], strict=True))
    want = Counter((w, k, tuple(i for i, x in enumerate(ws) if x == w)) for k, ws in texts if ws for w in set(ws) - {"", "the"})
    assert got == want
    if words_of_block > 1000:
        assert len(rows) == 2 * 4


def test_pairs_of_copies_are_dealt(spark, both, monkeypatch):
    monkeypatch.setattr(similar, "IDS_TOGETHER", 20)
    monkeypatch.setattr(similar, "ROWS_A_TASK", 10)
    names = ["red green blue"] * 150 + ["red green blues"] * 90 + ["green red", "plum", None, "", "red  green blue"]
    parts = spark.createDataFrame([(k, n, "a" if k % 5 else "b") for k, n in enumerate(names)], "p_partkey long, p_name string, p_type string").where("p_name IS NOT NULL")
    got, want = both("trigram_pairs", part=parts)
    assert got == want and want
    pairs = similar.similar_pairs(parts, "p_partkey", "p_name", ["p_type"], 0.5)
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(r[1] for r in tasks) < sum(want.values()) / 4


def test_only_wanted_comments_are_read(spark, both):
    from siltstone.sources import feeds

    events = spark.createDataFrame([(k, None, k % 5, "x") for k in range(60)], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    got, want = both("scan_threads", events=events)
    assert got == want and want
    items = spark.createDataFrame([('{"id": 1, "title": "Ask HN: Who is hiring?", "kids": [2, 3], "time": 1}',), ('{"id": 2, "text": "Acme | x"}',), ('{"id": 4, "text": "no"}',)], "payload string")
    found = feeds.threads(items, 3, 500)
    # a filter on texts stays above the join, which is done
    plan = found.where("text LIKE 'Acme%'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and [(r.story, r.comment) for r in found.collect()] == [(1, 2)]


def test_archives_are_read_in_parts_and_small_batches(tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from siltstone.sources import connector

    monkeypatch.setattr(connector, "PART_BYTES", 100_000)
    monkeypatch.setattr(connector, "BATCH_BYTES", 20_000)
    rows = [{"name": f"{k}.html", "target": f"t{k % 3}", "fetched_at": None, "payload": f"{k} " * (1000 if k % 2 else 300)} for k in range(200)]
    schema = pa.schema([("name", pa.string()), ("target", pa.string()), ("fetched_at", pa.timestamp("ns")), ("payload", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), tmp_path / "a.parquet", row_group_size=40)
    reader = connector.PayloadReader(str(tmp_path), list(connector.COLUMNS), None)
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) > 3 and [r for b in batches for r in b.to_pylist()] == rows
    assert max(b.get_total_buffer_size() for b in batches) < 200_000 and max(b.num_rows for b in batches) < 20
    reader.filters = [(connector.EqualTo, "target", "t1")]
    assert [r for p in parts for b in reader.read(p) for r in b.to_pylist()] == [r for r in rows if r["target"] == "t1"]
