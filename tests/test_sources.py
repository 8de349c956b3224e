"""Readers, writers and the stream."""

import json
from dataclasses import dataclass

import pytest

from terrane.operators import community
from terrane.sources import readers, writers
from terrane.streaming.associates import associate_stream


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_occurrence_parts_with_optional_columns(spark, tmp_path):
    full = [("10.5", "55.5", "u:Taxon:1", "A b", "v", "2020", "L1", "x")]
    spark.createDataFrame(full, readers.OCCURRENCE).write.parquet(str(tmp_path / "a/part1"))
    spark.createDataFrame(full, readers.OCCURRENCE).drop("localityID", "locality").write.parquet(str(tmp_path / "a/b/part2"))
    df = readers.occurrences(spark, str(tmp_path / "a"))
    assert df.columns == readers.OCCURRENCE.names and df.count() == 2 and df.filter("localityID IS NULL").count() == 1
    spark.createDataFrame([("1",)], "taxonID string").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        readers.occurrences(spark, str(tmp_path / "bad"))
    assert readers.parts(spark, str(tmp_path / "a/part1")).select("file").first()["file"].endswith(".parquet")


def test_id_lists(spark, tmp_path):
    red = _write(tmp_path / "red.csv", "Taxon id;x\n007;a\n5;b\n;c\n7;d\n")
    assert {r["id"] for r in readers.id_list(spark, red).collect()} == {"7", "5"}
    first = _write(tmp_path / "plants.csv", "some id;x\n12;a\n")
    assert [r["id"] for r in readers.id_list(spark, first, required=False).collect()] == ["12"]
    with pytest.raises(ValueError):
        readers.id_list(spark, first)
    out = _write(tmp_path / "out.csv", "taxonID;name\n 9 ;a\n;b\n")
    assert [r["id"] for r in readers.exclude_list(spark, out).collect()] == ["9"]
    assert readers.exclude_list(spark, str(tmp_path / "none.csv")).count() == 0 and readers.exclude_list(spark, "").count() == 0


def test_focal_lists(spark, tmp_path):
    for i, sep in enumerate(",;\t"):
        f = _write(tmp_path / f"f{i}.csv", sep.join(("taxonId", "scientificName")) + "\n# note\n" + sep.join(("012", "A b")) + "\n" + sep.join(("bad", "C d")) + "\n")
        with pytest.warns(UserWarning):
            got = {(r["kind"], r["value"]) for r in readers.focal_list(spark, f, [3], ["E f"]).collect()}
        assert got == {("id", "12"), ("id", "3"), ("name", "A b"), ("name", "C d"), ("name", "E f")}
    with pytest.warns(UserWarning):
        assert readers.focal_list(spark, str(tmp_path / "none.csv"), [3]).count() == 1


def test_site_lists_and_names(spark, tmp_path):
    for k, band in (("a", "\tlatband"), ("b", "")):
        (tmp_path / k).mkdir()
        _write(tmp_path / k / "Sites.txt", f"LocalityID\tSWEREF_N\tSWEREF_E{band}\tSpecies_IDs\nL1\t1\t2{'	LAT1' if band else ''}\t5 6\nNA\t1\tx{'	' if band else ''}\t7\n")
    df = readers.locality_lists(spark, str(tmp_path / "a" / "Sites.txt"))
    assert [tuple(r)[2:] for r in df.orderBy("row").collect()] == [("L1", "LAT1", 1.0, 2.0, "5 6"), (None, None, 1.0, None, "7")]
    assert readers.locality_lists(spark, str(tmp_path / "*" / "Sites.txt")).count() == 4
    assert {r["species_id"] for r in community.explode_lists(df, "locality_id", "species_ids").collect()} == {"5", "6"}
    names = readers.name_lookup(spark, _write(tmp_path / "n.csv", "taxonID;vernacular\n5;oak\n5;other\n6;NA\n"))
    index = spark.createDataFrame([(0, "5"), (1, "6")], "col_index int, species_id string")
    assert [r["species"] for r in community.named_species(index, names).orderBy("col_index").collect()] == ["oak", "6"]
    assert [r["species"] for r in readers.species_names(index, None).orderBy("col_index").collect()] == ["sp_00000", "sp_00001"]
    assert readers.latest(spark, str(tmp_path / "*")).endswith("n.csv")
    with pytest.raises(FileNotFoundError):
        readers.latest(spark, str(tmp_path / "zz*"))
    assert readers.optional_table(spark, str(tmp_path / "none.csv")) is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.5), (1, "b", None)], "cluster int, s string, x double")
    writers.write_csv(df, str(tmp_path / "c"), by="cluster")
    assert (tmp_path / "c" / "cluster=0").exists()
    writers.write_tsv(df, str(tmp_path / "t"))
    writers.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert "1.500000" in writers.text_table(df, "title")

    @dataclass(frozen=True)
    class Config:
        radius: float = 50.0

    writers.write_config(Config(), str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"radius": 50.0}
    cells = spark.createDataFrame([(0.0, 0.0, 10.0, 3)], "x0 double, y0 double, width double, colour_idx int")
    writers.svg_map(cells, str(tmp_path / "m.svg"))
    assert "<rect" in (tmp_path / "m.svg").read_text()


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    sites = spark.createDataFrame([("A", 1, 0.0, 0.0), ("B", 2, 100.0, 0.0)], "sci string, fid long, e double, n double")
    rows = [("t1", 10.0, 0.0), ("t1", 60.0, 0.0), ("t2", 100.0, 50.0), ("t3", 500.0, 0.0)]
    points = spark.createDataFrame(rows, "tid string, e double, n double")
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = associate_stream(sites, stream).writeStream.outputMode("complete").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("found").collect()}
    assert got == {tuple(r) for r in associate_stream(sites, points).collect()} == {("A", "t1", 1), ("B", "t1", 1), ("B", "t2", 1)}


@pytest.mark.parametrize("size", [300, 1000, 100_000])
def test_order_of_rows_holds_for_any_split(spark, tmp_path, size):
    """Splits are planned by size: the last, smaller one of a file may come first."""
    names = "taxonID;vernacular\n" + "".join(f"{i % 50};name {i:04d} {'x' * (i % 37)}\n" for i in range(400))
    (tmp_path / "names.csv").write_text(names)
    (tmp_path / "sites").mkdir()
    for f in "ab":
        (tmp_path / "sites" / f"{f}.tsv").write_text("LocalityID\tlatband\tSWEREF_N\tSWEREF_E\tSpecies_IDs\n" + "".join(f"loc {i % 40}\t{f.upper()}{i}\t{i}\t{i}\t{i % 7} {i}\n" for i in range(300)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = readers.name_lookup(spark, str(tmp_path / "names.csv"))
        assert [r["name"] for r in rows.orderBy("rank").collect()] == [line.split(";")[1].strip() for line in names.splitlines()[1:]]
        first = community.named_species(spark.createDataFrame([(i, str(i)) for i in range(50)], "col_index int, species_id string"), rows)
        assert all(r["species"].startswith(f"name {r['col_index']:04d}") for r in first.collect())
        lists = readers.locality_lists(spark, str(tmp_path / "sites" / "*.tsv"))
        bands = community.locality_summary(community.explode_lists(lists, "locality_id", "species_ids"))
        assert {r["locality_id"]: r["latband"] for r in bands.collect()} == {f"loc {i}": f"A{i}" for i in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
