import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from checks import streams as checked_streams
from sparktidy import Config, FastDataLoader, asof_join, get_config, range_join, reset_config, sql, to_records, update_config
from sparktidy.errors import DataLoadError, TidyError, UnsupportedOperationError
from sparktidy.operators import query
from sparktidy.operators.dedup import remove_duplicates
from sparktidy.operators.encode import fit_encoder
from sparktidy.operators.repair import clean_text
from sparktidy.operators.scale import fit_scaler
from sparktidy.operators.validate import ColumnSchema, DataSchema
from sparktidy.session import work_folder
from sparktidy.sources import csvrecords, files, footers
from sparktidy.streaming import streams


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [(i, n, s, b) for i, n, s, b in zip(range(1, 6), ["Al, x", 'Bo "q"', "C", None, "E"], [1.5, 2.0, None, 4.5, 5.0], [True, False, True, None, False])],
        "id long, name string, score double, pass_ boolean")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("suffix", ["csv", "jsonl", "parquet"])
def test_round_trip(spark, sample, tmp_path, suffix):
    path = str(tmp_path / f"t.{suffix}")
    files.save_data(sample, path)
    assert same(files.load_data(spark, path, schema=sample.schema), sample)
    loaded = FastDataLoader(spark).load(path)
    assert set(loaded.columns) == set(sample.columns) and loaded.count() == 5
    info = FastDataLoader(spark).get_info(path)
    assert info["n_rows"] == 5 and info["n_columns"] == 4 and info["size_bytes"] > 0


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": {"z": [1, 2]}}, {"x": 2, "y": null}]')
    (tmp_path / "o.json").write_text('{"x": 1,\n "y": "t"}')
    assert files.load_data(spark, str(tmp_path / "a.json")).count() == 2
    assert files.load_data(spark, str(tmp_path / "o.json")).first().x == 1


def test_csv_options_and_bad_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;b\n1;2024-01-01\nx;2024-01-02\n")
    df = files.load_data(spark, str(tmp_path / "c.csv"), schema="a int, b date", sep=";")
    assert [r.a for r in df.orderBy("b").collect()] == [1, None]
    (tmp_path / "l.csv").write_bytes("n\ncaf\xe9\n".encode("latin-1"))
    assert files.load_data(spark, str(tmp_path / "l.csv"), encoding="latin1").first().n == "caf\xe9"


def test_load_errors(spark, tmp_path):
    with pytest.raises(UnsupportedOperationError):
        files.load_data(spark, "table.xyz")
    with pytest.raises(DataLoadError):
        files.load_data(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(UnsupportedOperationError):
        files.save_data(spark.range(1), str(tmp_path / "a.xlsx"))


def test_convert_peek_export(spark, sample, tmp_path):
    source, target = str(tmp_path / "s.parquet"), str(tmp_path / "t.json")
    files.save_data(sample, source)
    files.convert_format(spark, source, target, format="json")
    assert files.load_data(spark, target, format="jsonl").count() == 5
    assert [r.id for r in files.peek(spark, source, 2, order_by=["id"]).collect()] == [1, 2]
    assert files.quick_export(sample, source).endswith("s_processed.csv")


def test_chunks(spark, sample, tmp_path):
    path = str(tmp_path / "s.parquet")
    files.save_data(sample, path)
    sizes = [[r.id for r in c.orderBy("id").collect()] for c in FastDataLoader(spark).stream_chunks(path, ["id"], 2)]
    assert sizes == [[1, 2], [3, 4], [5]]


def test_config(tmp_path):
    assert get_config().max_features_for_label == 300 and update_config(sample_size=5).sample_size == 5
    assert get_config().sample_size == 5 and reset_config().sample_size == 1000
    for bad in ({"random_state": -1}, {"chunk_size": 0}, {"correlation_threshold": 1.5}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(TypeError):
        update_config(colour=1)
    Config(chunk_size=7).to_file(tmp_path / "c.json")
    assert Config.from_file(tmp_path / "c.json").chunk_size == 7


def test_work_folder_follows_the_session(spark, tmp_path):
    class Named:
        """A session whose cluster names a shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: str(tmp_path) if key == "spark.checkpoint.dir" else default)

        sparkContext = spark.sparkContext

    one, two = work_folder(Named, "x"), work_folder(Named, "x")
    assert one.startswith(f"{tmp_path}/x-") and one != two


def test_sql(spark, sample):
    first = sql(sample, "SELECT id, score FROM data WHERE score > 2")
    second = sql(first, "SELECT count(*) AS n FROM data")
    assert second.first().n == 2 and first.count() == 2
    assert sql({"a": sample, "b": first}, "SELECT a.id FROM a JOIN b ON a.id = b.id").count() == 2
    assert to_records(first).orderBy("record").first().record == '{"id":4,"score":4.5}'
    with pytest.raises(TidyError):
        sql({}, "SELECT 1")


def test_joins(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1), (4, None, 7)], "id int, g string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 8, 80), ("b", 2, 20), (None, 6, 60)], "g string, t int, v int")
    out = {r.id: r.v for r in asof_join(left, right, "t", ["g"], ["v"]).collect()}
    assert out == {1: 50, 2: 80, 3: None, 4: None}  # as in SQL, a null group matches nothing
    points = spark.range(200).selectExpr("CASE WHEN id % 3 = 0 THEN 50 ELSE id END AS p", "id")
    bands = spark.createDataFrame([(1, 10.0, 20.0), (2, 45.0, 55.0), (3, 300.0, 400.0)], "b int, lo double, hi double")
    monkeypatch.setattr(query, "RANGE_ROWS", 20)
    got = range_join(points, bands, "p", "lo", "hi")
    want = points.join(bands, (points.p >= bands.lo) & (points.p < bands.hi))
    assert same(got.select("id", "b"), want.select("id", "b")) and got.count() > 67


def test_range_join_covers_runs_by_few_cells(spark):
    """Every run of cells is made up exactly once, by at most thirty cells a level."""
    runs = spark.createDataFrame([(a, b) for a in range(0, 600, 7) for b in [a, a + 1, a + 15, a + 16, a + 250, 599] if a <= b], "a int, b int")
    for r in runs.select("a", "b", query._cover(F.col("a"), F.col("b"), 3).alias("c")).collect():
        made = [x for level, cell in r.c for x in range(cell * 16**level, (cell + 1) * 16**level)]
        assert sorted(made) == list(range(r.a, r.b + 1)) and len(r.c) <= 90


def test_range_join_with_long_intervals_and_a_frequent_point(spark, monkeypatch):
    monkeypatch.setattr(query, "RANGE_ROWS", 200)
    points = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 50.0D WHEN id % 101 = 0 THEN NULL ELSE (id * 37) % 1000 / 10.0D END AS p")
    bands = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(
        [(-5.0, 500.0), (0.0, 100.0), (50.0, 50.1), (49.9, 50.0), (10.0, 10.0), (20.0, 5.0), (99.0, 1e9), (None, 5.0), (3.0, None), (7.0, 83.0)])],
        "b int, lo double, hi double")
    got = range_join(points, bands, "p", "lo", "hi")
    want = points.join(bands, (points.p >= bands.lo) & (points.p < bands.hi))
    assert got.count() == want.count() and same(got.select("id", "b"), want.select("id", "b"))


def test_range_join_spreads_its_pairs_over_tasks(spark, monkeypatch):
    """Few bytes that make many pairs: tasks follow the pairs, none takes much more than its share."""
    for name, value in (("CELL_RANGES", 1), ("RANGE_ROWS", 50), ("BLOCK_ROWS", 20), ("TASK_PAIRS", 10_000)):
        monkeypatch.setattr(query, name, value, raising=False)
    points = spark.range(2000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 50.0D ELSE (id * 37) % 1000 / 10.0D END AS p")
    bands = spark.range(300).selectExpr("id AS b", "id % 60 - 5.0D AS lo", "id % 60 + 45.0D AS hi", "map('k', id) AS m")
    want = points.join(bands, (points.p >= bands.lo) & (points.p < bands.hi))
    got = range_join(points, bands, "p", "lo", "hi")
    assert got.columns == ["id", "p", "b", "lo", "hi", "m"] and same(got.select("id", "b"), want.select("id", "b"))
    made = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(made) >= 20 and max(made) < sum(made) / 5
    twice = points.union(points), bands.union(bands.selectExpr("b", "NULL", "hi", "m")).union(bands)
    assert range_join(*twice, "p", "lo", "hi").count() == 4 * want.count()
    assert range_join(points, bands.where("lo > 1000"), "p", "lo", "hi").count() == 0
    assert range_join(points.where("p > 1000"), bands, "p", "lo", "hi").count() == 0


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """A table written in five files."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    df = spark.range(100).selectExpr("id", "concat(' t', id % 7, ' ') as t", "cast(id % 10 as double) as v",
                                     "timestamp_micros(id * 60000000) as ts")
    df.repartition(5).write.parquet(path)
    return path, df


def test_stream_equals_batch(spark, arriving):
    path, df = arriving
    scaler, coder = fit_scaler(df, "standard", ["v"]), fit_encoder(df, "label", ["t"], drop_original=False)

    def prepare(t):
        return clean_text(coder.transform(scaler.transform(t)), ["t"])

    stream = streams.read_stream(spark, path, df.schema, files_per_batch=2)
    assert same(streams.stream_table(prepare(stream)), prepare(df))


def test_stream_batches(spark, arriving):
    path, df = arriving
    counts = streams.stream_counts(streams.read_stream(spark, path, df.schema, files_per_batch=2))
    assert counts.count() == 3 and counts.agg({"rows": "sum"}).first()[0] == 100
    found = streams.stream_validation(streams.read_stream(spark, path, df.schema, files_per_batch=5), DataSchema([ColumnSchema("v", max_value=5.0)]))
    assert [(r.column, r.check) for r in found.collect()] == [("v", "max_value")]


def test_stream_dedup(spark, arriving):
    path, df = arriving
    stream = streams.read_stream(spark, path, df.schema, files_per_batch=1)
    unique = streams.stream_table(streams.stream_dedup(stream, ["t"], "ts", "1 day"))
    assert unique.count() == remove_duplicates(df, ["t"]).count() == 7


CELLS = ["", "plain", 'quo"te', "two\nlines", "win\r\ndows", '",\n"', "a,b", ' lead', '""', "\n\n", 'end"']


def read_cells(spark, path, **options):
    schema = "a string, b string, c string"
    return sorted(map(tuple, files.load_data(spark, path, schema=schema, **options).collect()), key=str)


@pytest.mark.parametrize("end,block", [("\n", 160), ("\r\n", 160), ("\n", 128 * 1024 * 1024)])
def test_csv_records_over_blocks(spark, tmp_path, end, block):
    """Cells with line ends, whatever the blocks a file is cut into."""
    draw, want = random.Random(block), []
    for name in ("x", "y"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            rows = csv.writer(out, lineterminator=end)
            rows.writerow(["a", "b", "c"])
            want += [(f"{name}{i}", draw.choice(CELLS), draw.choice(CELLS)) for i in range(60)]
            rows.writerows(want[-60:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        path = str(tmp_path)
        scanned = csvrecords.records(spark, path, '"', ",")
        assert scanned.count() == 122 and scanned.where("head").count() == 2
        assert read_cells(spark, path, format="csv") == sorted([tuple(c or None for c in row) for row in want], key=str)
        inferred = files.load_data(spark, path, format="csv")
        assert inferred.columns == ["a", "b", "c"] and inferred.count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_lone_quotes_keep_all_tasks(spark, tmp_path):
    """A quote inside a cell opens nothing; one at its start is closed or an error."""
    path = tmp_path / "inches.csv"
    path.write_text("a,b,c\n" + "".join(f'{i},5" pipe,x\n' for i in range(200)))
    assert read_cells(spark, str(path)) == sorted([(str(i), '5" pipe', "x") for i in range(200)], key=str)
    path = tmp_path / "open.csv"
    path.write_text("a,b,c\n" + "".join(f'{i},{chr(34) if i == 3 else ""}y,x\n' for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        with pytest.raises(DataLoadError):
            files.load_data(spark, str(path), schema="a string, b string, c string")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text('a",\n\r ', max_size=6), min_size=2, max_size=2), min_size=1, max_size=6), st.integers(1, 8))
def test_csv_blocks_agree_with_a_parser(rows, lines_a_block):
    """Cut anywhere between lines, the case that holds gives a parser's records."""
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    lines = out.getvalue().split("\n")[:-1]
    inside, got, chains = False, [], []
    for start in range(0, len(lines), lines_a_block):
        block = csvrecords._Block("f", start, '"', ",")
        for line in lines[start:start + lines_a_block]:
            block.add(line)
        block.finish()
        *parts, summary = block.taken()
        held = [(kind, text) for _, _, kind, case, _, text, _, _ in parts if case in (csvrecords.EITHER, int(inside))]
        got += [text for kind, text in held if kind == csvrecords.WHOLE]
        for kind, text in sorted(p for p in held if p[0] != csvrecords.WHOLE):
            chains += [[text]] if kind == csvrecords.TAIL else []
            if kind == csvrecords.LEAD:
                chains[-1].append(text)
        inside = summary[7] if inside else summary[6]
    got += ["\n".join(c) for c in chains]
    assert not inside
    assert len(got) == len(rows)
    assert sorted(next(csv.reader(io.StringIO(g, newline=""))) for g in got) == sorted(rows)


def test_footers(spark, tmp_path):
    """Counts, bounds and rows by number over several files, row groups and folders."""
    path = str(tmp_path / "t.parquet")
    rows = spark.range(3000).select(
        "id", (F.col("id") % 3).cast("int").alias("part"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("x"),
        F.array(F.col("id").cast("string")).alias("names"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("parquet.block.size", 4096).partitionBy("part").parquet(path)
    assert footers.row_groups(spark, path).agg(F.sum("n_rows")).first()[0] == 3000
    facts = {r["column"]: r for r in footers.column_facts(spark, path).collect()}
    assert facts["x"].n_nulls == 600 and (facts["x"].low, facts["x"].high) == (0.25, 749.75)
    assert facts["day"].low == 18262 * 86_400_000_000.0
    assert facts["names.list.element"].low is None
    cut = footers.read_chunks(spark, path, 700)
    assert cut.drop("chunk_id").schema.simpleString() == spark.read.parquet(path).schema.simpleString()
    assert same(cut.drop("chunk_id"), spark.read.parquet(path))
    assert sorted(r["count"] for r in cut.groupBy("chunk_id").count().collect()) == [200, 700, 700, 700, 700]
    chunks = list(FastDataLoader(spark).stream_chunks(path, chunk_size=1100))
    assert [c.count() for c in chunks] == [1100, 1100, 800]
    assert sum(c.agg(F.sum("id")).first()[0] for c in chunks) == 3000 * 2999 // 2
    assert files.table_info(spark, path).first().n_rows == 3000
    assert footers.read_chunks(spark, path, 10, ["day"]).columns == ["day", "chunk_id"]


def test_row_estimates_and_chunks_of_other_files(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    files.save_data(spark.range(100_000, 130_000).repartition(3), path)
    assert abs(files.estimate_rows(spark, path) - 30_000) < 150
    assert abs(files.table_info(spark, path, exact=False).first().n_rows - 30_000) < 150
    assert abs(FastDataLoader(spark).get_info(path, exact=False)["n_rows"] - 30_000) < 150
    few = str(tmp_path / "few.jsonl")
    files.save_data(spark.range(7), few)
    assert files.estimate_rows(spark, few, header=False) == 7
    with pytest.raises(UnsupportedOperationError):
        next(FastDataLoader(spark).stream_chunks(path))


def test_chunks_of_a_union_keep_their_tasks(spark, tmp_path):
    """A union of chunks reads them in a task each, and a chunk over several files keeps the order."""
    path = str(tmp_path / "t.parquet")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    chunks = list(FastDataLoader(spark).stream_chunks(path, chunk_size=150))
    assert [[r.id for r in c.collect()] for c in chunks] == [list(range(at, min(at + 150, 1000))) for at in range(0, 1000, 150)]
    both = chunks[0].unionByName(chunks[3]).select(F.spark_partition_id().alias("task"))
    assert both.distinct().count() > 1
    assert "Sort" not in both._jdf.queryExecution().executedPlan().toString()
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    assert list(FastDataLoader(spark).stream_chunks(str(tmp_path / "none.parquet"))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('a",\r ', max_size=6), min_size=1, max_size=30), st.integers(1, 8), st.integers(0, 1))
def test_csv_lines_in_batches(lines, batch, block):
    """Lines handed over in batches give what they give one by one."""
    single, many = csvrecords._Block(1, block, '"', ","), csvrecords._Block(1, block, '"', ",")
    for line in lines:
        single.add(line)
    for at in range(0, len(lines), batch):
        many.add_all(lines[at:at + batch])
    single.finish()
    many.finish()
    assert many.taken() == single.taken()


def test_csv_lines_carry_no_path(spark, tmp_path):
    """A file is a number beside each line; its path comes back with the records."""
    path = str(tmp_path / "t.csv")
    files.save_data(spark.range(40).select("id", F.concat_ws("\n", F.lit("x"), "id").alias("t")).repartition(3), path)
    found = csvrecords.records(spark, path, '"', ",")
    assert found.select("file").distinct().count() == 3
    assert {r.file.rsplit("/", 2)[1] for r in found.select("file").collect()} == {"t.csv"}
    assert T.StructType.fromDDL(csvrecords.SCANNED)["file"].dataType == T.LongType()
    assert files.load_data(spark, path).count() == 40


def test_stream_input_pieces_follow_the_table(spark):
    """Larger tables are written in more pieces, in no more batches."""
    stream = checked_streams._stream(spark, spark.range(0, 1000, 1, 10))
    counts = streams.stream_counts(stream).collect()
    assert len(counts) == 4 and sum(r.rows for r in counts) == 1000
    small = streams.stream_table(checked_streams._stream(spark, spark.range(0, 1000, 1, 10)).select("id", F.col("_metadata.file_path").alias("piece")))
    assert small.select("piece").distinct().count() == 12
