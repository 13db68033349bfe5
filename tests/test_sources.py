"""Saved tables (S4, S5), text files (S6) and the summary sink."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from precis.sources.saved import scan_saved, scan_saved_dir, scan_saved_split
from precis.sources.sinks import write_summaries
from precis.sources.textfiles import scan_text_files


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="precis-src-", dir="/tmp")


def _write(spark, path, rows, schema="text string, summary string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def test_saved_dir_layouts(spark, folder):
    _write(spark, f"{folder}/a/train", [("t1", "s1"), ("", "s")])
    _write(spark, f"{folder}/a/test", [("x", "y")])
    open(f"{folder}/a/dataset_dict.json", "w").write("{}")
    _write(spark, f"{folder}/b/train", [("t2", "s2")])
    _write(spark, f"{folder}/c/test", [("only", "test")])
    open(f"{folder}/c/dataset_dict.json", "w").write("{}")
    _write(spark, f"{folder}/temp_cache/train", [("skip", "me")])
    os.makedirs(f"{folder}/empty")
    _write(spark, f"{folder}/wrong/train", [("x", 1)], "foo string, bar int")
    msgs = []
    df = scan_saved_dir(spark, folder, msgs)
    got = sorted((r["source"], r["text"]) for r in df.collect())
    assert got == [("a", "t1"), ("b", "t2")]
    assert any("wrong" in m for m in msgs)


def test_saved_dir_missing_and_empty(spark, folder):
    msgs = []
    assert scan_saved_dir(spark, f"{folder}/nope", msgs) is None
    os.makedirs(f"{folder}/x")
    assert scan_saved_dir(spark, f"{folder}/x", msgs) is None
    assert scan_saved(spark, f"{folder}/nope", msgs) is None
    assert "not found" in msgs[-1]


def test_saved_split_taken_as_is(spark, folder):
    _write(spark, f"{folder}/d/test", [("", "kept"), ("a", None)])
    df = scan_saved_split(spark, f"{folder}/d", "test")
    assert df.count() == 2  # T16: no filter
    with pytest.raises(ValueError, match="test split"):
        _write(spark, f"{folder}/e/train", [("a", "b")])
        scan_saved_split(spark, f"{folder}/e", "test")


def test_text_files_strict_utf8(spark, folder):
    with open(f"{folder}/a.txt", "w", encoding="utf-8") as f:
        f.write("Bonjour l'été")
    with open(f"{folder}/b.md", "w", encoding="utf-8") as f:
        f.write("# Titre\ntexte")
    with open(f"{folder}/bad.txt", "wb") as f:
        f.write(b"abc\xc3")
    with open(f"{folder}/c.csv", "w") as f:
        f.write("a,b")
    rows = {os.path.basename(r["path"]): r for r in scan_text_files(spark, folder).collect()}
    assert set(rows) == {"a.txt", "b.md", "bad.txt"}
    assert rows["a.txt"]["text"] == "Bonjour l'été" and rows["a.txt"]["error"] is None
    assert rows["bad.txt"]["text"] is None and rows["bad.txt"]["error"]


def test_text_files_written_in_folders_of_bounded_size(spark, folder):
    from precis.sources.textfiles import write_text_files
    rows = [(7, "a"), (7, "b\nc"), (None, "sans"), (3, ""), (-1, "été")] + [(100 + i, f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, value string")
    write_text_files(docs.coalesce(1), f"{folder}/all", "doc_id", folder_files=4)
    got = {os.path.basename(r["path"]): (r["text"], r["n_bytes"]) for r in scan_text_files(spark, f"{folder}/all").collect()}
    assert got["doc_id=7.txt"] in {("a\nb\nc\n", 6), ("b\nc\na\n", 6)}
    assert got["doc_id=null.txt"] == ("sans\n", 5) and got["doc_id=3.txt"] == ("\n", 1) and got["doc_id=-1.txt"] == ("été\n", 6)
    assert len(got) == 24 and all(got[f"doc_id={100 + i}.txt"][0] == f"t{i}\n" for i in range(20))
    assert sorted(len(os.listdir(f"{folder}/all/{d}")) for d in os.listdir(f"{folder}/all")) == [4] * 6
    write_text_files(docs.limit(0), f"{folder}/none", "doc_id")
    assert scan_text_files(spark, f"{folder}/none").count() == 0


def test_text_files_are_listed_and_read_by_tasks(spark, folder):
    """The driver holds no file, and tasks do not grow in number with files that are small."""
    for k in range(600):
        os.makedirs(f"{folder}/d{k % 7}/deep", exist_ok=True)
        open(f"{folder}/d{k % 7}/{'deep/' * (k % 2)}{k}.txt", "w").write(f"texte {k}")
    df = scan_text_files(spark, folder)
    assert not [f for f in df.inputFiles() if f.endswith(".txt")]
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["text"] for r in df.collect()) == sorted(f"texte {k}" for k in range(600))


def test_text_files_spread_over_tasks_by_number_and_size(spark, folder, monkeypatch):
    from precis.sources import textfiles
    for k in range(60):
        open(f"{folder}/{k}.md", "w").write("x" * 100)
    for name, most, tasks in (("TASK_FILES", 6, 10), ("TASK_BYTES", 200, 30)):
        with monkeypatch.context() as m:
            m.setattr(textfiles, name, most)
            df = scan_text_files(spark, folder)
            assert df.rdd.getNumPartitions() == tasks and df.count() == 60


def test_text_file_batches_are_bounded(folder):
    import pyarrow as pa
    from precis.sources import textfiles
    names = []
    for k in range(2500):
        open(f"{folder}/{k}.txt", "w").write(str(k) if k < 2490 else "x" * 6_000_000)
        names.append(f"file:{folder}/{k}.txt")
    given = [pa.RecordBatch.from_arrays([pa.array(names)], ["path"])]
    read = list(textfiles._contents(iter(given)))
    assert [p for b in read for p in b["path"].to_pylist()] == names
    assert [b.num_rows for b in read] == [1000, 1000, 493, 3, 3, 1]
    listed = [r for b in textfiles._entries([pa.RecordBatch.from_arrays([pa.array([f"file:{folder}"])], ["path"])]) for r in b.to_pylist()]
    assert sorted(r["path"] for r in listed) == sorted(names) and sum(r["n_bytes"] for r in listed) == 60_000_000 + 8850


def test_text_files_are_those_of_the_reader_of_spark(spark, folder):
    """Hidden, empty and other files, patterns, odd names, links, and a store that tasks cannot open."""
    for name in ("a.txt", "b.md", "c.csv", "D.TXT", "empty.txt", "_h.txt", "_x=1.txt", ".dot.txt", "_metadata.txt", "sub/deep/e.txt",
                 "_hid/f.txt", "_k=v/g.txt", ".hid/h.txt", "_metadata/i.txt", "w._COPYING_/j.txt", "sp ace +%25é/k l%20+.txt",
                 "dir.txt/m.txt", "a.txt.gz", "n\nl.txt"):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        open(f"{folder}/{name}", "w").write("" if name == "empty.txt" else name)
    os.symlink(f"{folder}/sub", f"{folder}/link")
    os.makedirs(f"{folder}/nothing")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./in", f"file://{folder}")
    for path, n in ((folder, 10), (f"file://{folder}/", 10), (f"{folder}/_hid", 1), (f"{folder}/_h.txt", 0), (f"{folder}/a.txt", 1),
                    (f"{folder}/*.txt", 4), (f"{folder}/{{sub,_hid}}", 2), (f"{folder}/sp ace +%25é", 1), (f"{folder}/nothing", 0),
                    ("viewfs://texts/in", 10)):
        want = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", "true").load(path)
        want = sorted((r["path"], bytes(r["content"]).decode(), None, r["length"]) for r in want.collect())
        assert sorted(map(tuple, scan_text_files(spark, path).collect())) == want and len(want) == n, path
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_text_files(spark, f"{folder}/nope")


def test_write_summaries_round_trip(spark, folder):
    df = spark.createDataFrame([(1, "un"), (2, "deux")], "pair_id long, summary string")
    write_summaries(df, f"{folder}/pq")
    assert sorted(r["summary"] for r in spark.read.parquet(f"{folder}/pq").collect()) == ["deux", "un"]
    write_summaries(df, f"{folder}/txt", as_text=True)
    assert sorted(r["value"] for r in spark.read.text(f"{folder}/txt").collect()) == ["deux", "un"]


def test_parquet_registry_source_keeps_file_order(spark, folder):
    from precis.sources.registry import Registry, SourceSpec
    from precis.sources import scan
    a = [(f"src{i}", f"tgt{i}", i) for i in range(5)] + [("", "dropped", 99)]
    b = [(f"src{i}", f"tgt{i}", i) for i in range(5, 8)]
    spark.createDataFrame(a, "source string, target string, extra int").repartition(1) \
        .sortWithinPartitions("extra").write.parquet(f"{folder}/fr/train/0000")
    spark.createDataFrame(b, "source string, target string, extra int").coalesce(1) \
        .write.parquet(f"{folder}/fr/train/0001")
    spec = SourceSpec("wiki", text_column="source", summary_column="target",
                      parquet_files={"train": ("fr/train/0000", "fr/train/0001"), "test": ("fr/train/0001",)})
    reg = Registry((spec,))
    df = scan.load_source(spark, "wiki", "train", None, folder, reg)
    assert df.columns == ["pair_id", "text", "summary"]
    rows = sorted(df.collect(), key=lambda r: r["pair_id"])
    assert [r["text"] for r in rows] == [f"src{i}" for i in range(8)]
    first3 = scan.load_source(spark, "wiki", "train", 3, folder, reg).collect()
    assert sorted(r["text"] for r in first3) == ["src0", "src1", "src2"]
    with pytest.raises(ValueError, match="choose from: train, test"):
        scan.load_source(spark, "wiki", "validation", None, folder, reg)


def _keys_are_positions(df, want):
    rows = sorted(df.collect(), key=lambda r: r["pair_id"])
    assert [r["pair_id"] for r in rows] == list(range(len(rows)))
    assert [r["text"] for r in rows] == want


def test_file_keys_are_unique_and_in_table_order(spark, folder):
    from precis.sources.files import read_in_order
    rows = [(f"t{k:04d}", "s") for k in range(20)]
    schema = "text string, summary string"
    spark.createDataFrame(rows, schema).coalesce(1).write.option("maxRecordsPerFile", 4).parquet(f"{folder}/cut")
    _keys_are_positions(read_in_order(spark, [f"{folder}/cut"]), [t for t, _ in rows])
    os.makedirs(f"{folder}/plain/deep")
    for k in range(5):
        one = f"{folder}/tmp{k}"
        spark.createDataFrame(rows[4 * k:4 * k + 4], schema).coalesce(1).write.parquet(one)
        part = next(f"{one}/{x}" for x in os.listdir(one) if x.endswith(".parquet"))
        os.link(part, f"{folder}/plain/{'deep/' if k > 2 else ''}{k:04d}0.parquet".replace("deep/", "deep/" if k > 2 else ""))
    got = read_in_order(spark, [f"{folder}/plain"])
    _keys_are_positions(got, [t for t, _ in rows])
    listed = [f"{folder}/plain/00020.parquet", f"{folder}/plain/deep", f"{folder}/cut"]
    _keys_are_positions(read_in_order(spark, listed), [t for t, _ in rows[8:] + rows])


def test_saved_split_starts_with_its_first_file(spark, folder):
    os.makedirs(f"{folder}/d/test")
    for k, n in ((0, 3), (1, 3000)):
        _write(spark, f"{folder}/part{k}", [])
        spark.createDataFrame([(f"p{k}-{i}", "s") for i in range(n)], "text string, summary string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{folder}/part{k}")
        part = next(x for x in os.listdir(f"{folder}/part{k}") if x.endswith(".parquet"))
        os.link(f"{folder}/part{k}/{part}", f"{folder}/d/test/part-0000{k}.parquet")
    from precis.operators.ordering import first_n
    df = scan_saved_split(spark, f"{folder}/d", "test")
    assert sorted(r["text"] for r in first_n(df, 4).collect()) == ["p0-0", "p0-1", "p0-2", "p1-0"]


def test_saved_dir_keys_run_on_from_child_to_child(spark, folder):
    for name in "ab":
        _write(spark, f"{folder}/{name}/train", [(f"{name}{k}", "s") for k in range(30)])
    df = scan_saved_dir(spark, folder)
    _keys_are_positions(df, [f"{n}{k}" for n in "ab" for k in range(30)])


def test_saved_dir_keys_stay_unique_behind_a_child_of_one_row(spark, folder):
    for name, n in (("a", 1), ("b", 1), ("c", 0), ("d", 3)):
        _write(spark, f"{folder}/{name}/train", [(f"{name}{k}", "s") for k in range(n)])
    df = scan_saved_dir(spark, folder)
    _keys_are_positions(df, ["a0", "b0", "d0", "d1", "d2"])


def test_summaries_with_line_ends_come_back(spark, folder):
    from precis.sources.sinks import read_summaries, write_summaries
    texts = ["one", "two\nlines", "", "back\\slash", "\\n is no line end", "\\\n", "\r\n", "\\", "a\\\\n\n\\r\r", "é\u2028x", "\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "pair_id long, summary string").coalesce(1)
    write_summaries(df, f"{folder}/out", as_text=True)
    assert [r["summary"] for r in read_summaries(spark, f"{folder}/out").collect()] == texts + [""]
    assert spark.read.option("lineSep", "\n").text(f"{folder}/out").count() == len(texts) + 1


def _some_files(spark, folder, n, rows=2):
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(folder)
    for k in range(n):
        pq.write_table(pa.table({"text": [f"t{k:05d}-{j}" for j in range(rows)], "summary": ["s"] * rows}), f"{folder}/f{k:05d}.parquet")


def test_inventory_of_thousands_of_files_takes_a_constant_number_of_calls(spark, folder, monkeypatch):
    from precis.sources.files import read_in_order
    client, sent = type(spark.sparkContext._gateway._gateway_client), []
    plain = client.send_command

    def counted(self, *args, **kwargs):
        sent.append(1)
        return plain(self, *args, **kwargs)
    calls = []
    for n in (3, 2000):
        _some_files(spark, f"{folder}/n{n}", n)
        with monkeypatch.context() as m:
            m.setattr(client, "send_command", counted)
            sent.clear()
            df = read_in_order(spark, [f"{folder}/n{n}"])
            calls.append(len(sent))
        _keys_are_positions(df, [f"t{k:05d}-{j}" for k in range(n) for j in range(2)])
    assert calls[1] <= calls[0] + 100, calls


def test_broken_and_empty_files(spark, folder):
    from precis.sources.files import BrokenFiles, broken_files, inventory, read_in_order, read_what_is_whole
    path = f"{folder}/with +odd name%"
    _some_files(spark, path, 4)
    _some_files(spark, f"{folder}/none", 1, rows=0)
    os.rename(f"{folder}/none/f00000.parquet", f"{path}/f00001a.parquet")
    whole = open(f"{path}/f00002.parquet", "rb").read()
    open(f"{path}/f00002.parquet", "wb").write(whole[:-30])
    files = {os.path.basename(r["plain"]): (r["n"], r["error"] is None) for r in inventory(spark, [path]).collect()}
    assert files == {"f00000.parquet": (2, True), "f00001.parquet": (2, True), "f00001a.parquet": (0, True),
                     "f00002.parquet": (None, False), "f00003.parquet": (2, True)}
    assert broken_files(inventory(spark, [path])).n == 1
    with pytest.raises(BrokenFiles, match="1 unreadable file.*f00002.parquet"):
        read_in_order(spark, [path])
    rows, _, missing = read_what_is_whole(spark, [path])
    _keys_are_positions(rows, [f"t{k:05d}-{j}" for k in (0, 1, 3) for j in range(2)])
    assert missing() == 0


def test_rows_that_a_file_lacks_are_counted(spark, folder):
    """A file whose footer is whole but whose pages are not."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from precis.sources.files import read_what_is_whole
    os.makedirs(f"{folder}/d")
    for k in range(2):
        pq.write_table(pa.table({"text": [f"{k}-{j}-" + "x" * 50 for j in range(1000)], "summary": ["s"] * 1000}),
                       f"{folder}/d/f{k}.parquet", compression="snappy", use_dictionary=False)
    raw = bytearray(open(f"{folder}/d/f1.parquet", "rb").read())
    raw[40:400] = b"\xff" * 360
    open(f"{folder}/d/f1.parquet", "wb").write(bytes(raw))
    rows, files, missing = read_what_is_whole(spark, [f"{folder}/d"])
    assert files.where("error IS NOT NULL").count() == 0
    got = rows.select("text").collect()
    assert len(got) < 2000 and missing() == 2000 - len(got)


def test_a_source_with_a_broken_shard_is_left_out_and_reported(spark, folder):
    from precis.sources import scan
    from precis.sources.registry import Registry, SourceSpec
    for name in "ab":
        _some_files(spark, f"{folder}/{name}", 3)
    open(f"{folder}/b/f00009.parquet", "wb").write(b"PAR1")
    reg = Registry(tuple(SourceSpec(n, parquet_files={"train": (n,)}) for n in "ab"))
    report = []
    df = scan.load_pairs(spark, "all", "train", None, folder, reg, report)
    assert {r["source"] for r in df.collect()} == {"a"}
    assert [(r.source, r.status, r.broken_files) for r in report] == [("a", "loaded", 0), ("b", "failed", 1)]
    assert "f00009.parquet" in report[1].error
