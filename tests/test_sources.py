"""Archives, folders and files give equal rows; snapshots that broke off or were damaged are never restored."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from playlore.functions.scratch import children
from playlore.sources import archives, ingest, snapshots


def entry(i, **more):
    return {"ts": f"2024-05-{i % 28 + 1:02d}T10:00:{i % 60:02d}Z", "spotify_track_uri": f"spotify:track:t{i}", "master_metadata_track_name": f"Söng {i}", "master_metadata_album_artist_name": "Band", "ms_played": 1000 * i, "shuffle": i % 2 == 0, "conn_country": "GB"} | more


FILES = {
    "Spotify Data/Streaming_History_Audio_2023_1.json": [entry(i) for i in range(50)],
    "Spotify Data/Streaming_History_Audio_2024_2.json": [entry(i, spotify_episode_uri="e" if i == 3 else None) for i in range(50, 9_000)],
    "Streaming_History_Audio_empty.json": [],
    "ReadMe.json": [{"ts": "never"}],
    "Streaming_History_Video_2024.json": [entry(1)],
}


def lay_out(folder):
    for name, rows in FILES.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=1 if "2023" in name else None, ensure_ascii=False)


def pack(folder, path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in FILES:
            z.write(f"{folder}/{name}", name)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_zip_folder_and_file_give_equal_rows(spark, tmp_path):
    folder, zipped = str(tmp_path / "plain"), str(tmp_path / "export.zip")
    lay_out(folder)
    pack(folder, zipped)
    want = rows_of(ingest.read_export(spark, folder, "o"))
    assert len(want) == 9_000
    archive = archives.read_archive(spark, zipped, "o")
    assert rows_of(archive) == rows_of(archives.read_archive(spark, folder, "o")) == want
    assert archive.rdd.getNumPartitions() == 3  # one for each member that is wanted
    one = archives.read_archive(spark, f"{folder}/Spotify Data/Streaming_History_Audio_2023_1.json", "o")
    assert rows_of(one) == rows_of(ingest.read_export(spark, folder, "o").filter("source_file like '%2023_1.json'"))
    os.makedirs(tmp_path / "both")
    pack(folder, str(tmp_path / "both" / "a.zip"))
    assert rows_of(archives.read_archive(spark, f"file://{tmp_path}/both", "o")) == want
    assert archives.read_archive(spark, zipped, "o", "nothing*.json").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_arrays_are_decoded_piece_by_piece(monkeypatch, piece):
    monkeypatch.setattr(archives, "PIECE", piece)
    values = [{"a": 'x]",[{'}, 12, 345.5, "é", None, True, [1, [2]], {"b": {"c": []}}]
    assert list(archives.objects(io.StringIO("\ufeff \n" + json.dumps(values, indent=2)), "f")) == values
    assert list(archives.objects(io.StringIO("[]"), "f")) == list(archives.objects(io.StringIO(""), "f")) == []
    for broken in ('[{"a": 1}, {"b"', "[1, 2", '{"a": 1}', "[1, nope]"):
        with pytest.raises(ValueError, match="f: "):
            list(archives.objects(io.StringIO(broken), "f"))


def test_values_of_another_kind_are_null(spark, tmp_path):
    path = tmp_path / "Streaming_History_Audio_x.json"
    path.write_text(json.dumps([entry(1, ms_played="long", shuffle=1), entry(2, ms_played=2**70), "no object", entry(3, platform={"os": 1})]))
    got = archives.read_archive(spark, str(path), "o").orderBy("spotify_track_uri").collect()
    assert [(r.ms_played, r.shuffle, r.platform) for r in got] == [(None, None, None), (None, True, None), (3000, False, '{"os": 1}')]


def test_what_is_not_there_or_breaks_off_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="missing.zip"):
        archives.read_archive(spark, str(tmp_path / "missing.zip"), "o").count()
    (tmp_path / "Streaming_History_Audio_y.json").write_text('[{"ts": "2024')
    with pytest.raises(Exception, match="breaks off"):
        archives.read_archive(spark, str(tmp_path), "o").count()


# ---- snapshots ----


def tables(spark, n):
    return {"a": spark.range(n).withColumn("m", F.create_map(F.lit("k"), F.col("id"))), "b": spark.createDataFrame([(1, "x")] * n, "k int, v string")}


def test_only_complete_snapshots_are_restored_and_fourteen_kept(spark, tmp_path):
    root = str(tmp_path / "snaps")
    with pytest.raises(ValueError, match="no complete"):
        snapshots.restore(spark, root)
    for k in range(3):
        snapshots.snapshot(tables(spark, k + 1), root, f"2024050{k}", keep=2)
    assert snapshots.complete(spark, root) == ["20240501", "20240502"]
    boom = spark.range(5).select(F.raise_error(F.lit("killed")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        snapshots.snapshot({"a": spark.range(99).toDF("id"), "b": boom}, root, "20240503", keep=2)
    assert "20240503" in children(spark, root) and snapshots.complete(spark, root)[-1] == "20240502"
    back = snapshots.restore(spark, root)
    assert (back["a"].count(), back["b"].count()) == (3, 3) and back["a"].first().m
    with pytest.raises(ValueError, match="20240503"):
        snapshots.restore(spark, root, stamp="20240503")
    snapshots.snapshot(tables(spark, 7), root, "20240504", keep=2)
    assert children(spark, root) == ["20240502", "20240504"]  # the broken one is cleared away
    with pytest.raises(ValueError, match="there is a complete"):
        snapshots.snapshot(tables(spark, 1), root, "20240504")


def test_a_snapshot_fits_current_columns_and_damage_is_seen(spark, tmp_path):
    root = str(tmp_path / "snaps")
    snapshots.snapshot(tables(spark, 4), root, "1")
    now = {"b": spark.createDataFrame([], "v string, w double")}
    back = snapshots.restore(spark, root, now)["b"]
    assert back.columns == ["v", "w"] and [tuple(r) for r in back.collect()] == [("x", None)] * 4
    spark.createDataFrame([(1, "x")], "k int, v string").write.mode("append").parquet(f"{root}/1/b")
    with pytest.raises(snapshots.Damaged, match="5 rows, 4 were written"):
        snapshots.restore(spark, root)
