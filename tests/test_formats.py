import pytest

from graphloom import cli
from graphloom.sources import readers, writers

from .test_miner import EDGES, LABELS

WANT = {(a, b, 0) for a, b in EDGES}


def plain(v, e):
    return {r.vid: r.label for r in v.collect()}, {(r.src, r.dst, r.elabel) for r in e.collect()}


def near(i):
    return sorted([b for a, b in EDGES if a == i] + [a for a, b in EDGES if b == i])


def txt(path):
    path.write_text("t # 0\n" + "".join(f"v {i} {x} extra\n" for i, x in enumerate(LABELS)) + "e 1\n" + "".join(f"e {a}  {b}\t0\n" for a, b in EDGES) + "e 3 3 0\ne 1 0 0\nt # 1\nv 0 5\n")
    return str(path)


def adj(path):
    path.write_text(f"8 {len(EDGES)} 011\n" + "".join(f"{LABELS[i] + 1} " + " ".join(f"{j + 1} 1" for j in near(i)) + "\n" for i in range(8)))
    return str(path)


def test_all_formats_agree(spark, tmp_path):
    want = (dict(enumerate(LABELS)), WANT)
    assert plain(*readers.read_graph(spark, "-txt", txt(tmp_path / "g.txt"))) == want
    assert plain(*readers.read_graph(spark, "adj", adj(tmp_path / "g.adj"))) == want
    (tmp_path / "parts").write_text("0\n0\n0\n0\n1\n1\n1\n1\n")
    v, e = readers.read_graph(spark, "adjp", str(tmp_path / "g.adj"), str(tmp_path / "parts"))
    assert plain(v, e) == want and {r.vid: r.part_id for r in v.collect()} == {i: i // 4 for i in range(8)}
    files = writers.convert_to_partitions(spark, str(tmp_path / "g.adj"), str(tmp_path / "parts"), f"{tmp_path}/local")
    assert [f.rsplit("/", 1)[1] for f in files] == ["0", "1"]
    v, e = readers.read_graph(spark, "-ladjp", f"{tmp_path}/local")
    assert plain(v, e) == want and {r.vid: r.part_id for r in v.collect()} == {i: i // 4 for i in range(8)}
    head = (tmp_path / "local" / "0").read_text().split("\n")
    ghosts = {b for a, b in EDGES if a < 4 <= b}
    assert int(head[0]) == 4 + len(ghosts) and all(x.startswith("0 ") for x in head[1:5])
    writers.write_txt(v, e, f"{tmp_path}/again")
    assert plain(*readers.read_graph(spark, "txt", f"{tmp_path}/again")) == want


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown filetype"):
        readers.read_graph(spark, "-csv", "x")
    with pytest.raises(ValueError, match="partition file"):
        readers.read_graph(spark, "adjp", "x")
    (tmp_path / "bad.txt").write_text("t # 0\nv 0 1\ne 0 9 0\n")
    with pytest.raises(ValueError, match="Format Error"):
        readers.read_graph(spark, "txt", str(tmp_path / "bad.txt"))


def test_command_line(spark, tmp_path, capsys):
    path = txt(tmp_path / "g.txt")
    assert cli.main(["mine", "-txt", path, "2", "--max-edges", "2"], spark) == 0
    assert "[total_frequent_graphs=8]" in capsys.readouterr().out
    assert cli.main(["mine", "-txt", path, "4", f"{tmp_path}/out", "--max-edges", "1"], spark) == 0
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == ["(0 1 0 0 0):4", "(0 1 0 0 1):4"]
    assert cli.main(["mine", "-txt", path, "0"], spark) == 3
    adj(tmp_path / "g.adj")
    (tmp_path / "p").write_text("0\n" * 4 + "1\n" * 4)
    assert cli.main(["convert", str(tmp_path / "g.adj"), str(tmp_path / "p"), f"{tmp_path}/parts"], spark) == 0
    assert writers.canonical_text([1, 0], [(0, 1, 3)]) == "(0 1 0 3 1)"


def test_many_part_files_of_rising_size(spark, tmp_path):
    """Spark scans large files first; lines keep their order all the same."""
    import random

    rng = random.Random(3)
    n = 400
    labels = [i * i % 17 for i in range(n)]
    edges = sorted({(min(a, b), max(a, b), (a + b) % 3) for a, b in ((rng.randrange(n), int(n * rng.random() ** 0.3)) for _ in range(3000)) if a != b and max(a, b) < n})
    v = spark.createDataFrame([(i, x, i % 4) for i, x in enumerate(labels)], "vid long, label int, part_id int")
    e = spark.createDataFrame(edges, "src long, dst long, elabel int")
    want = (dict(enumerate(labels)), set(edges))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for kind, write in (("adj", writers.write_adj), ("txt", writers.write_txt)):
            write(v, e, f"{tmp_path}/{kind}")
            sizes = [f.stat().st_size for f in sorted((tmp_path / kind).glob("part-*"))]
            assert len(sizes) >= 4 and len(set(sizes)) > 1
            assert plain(*readers.read_graph(spark, kind, f"{tmp_path}/{kind}")) == want
        v.orderBy("vid").select(v["part_id"].cast("string").alias("value")).write.text(f"{tmp_path}/parts")
        v2, _ = readers.read_graph(spark, "adjp", f"{tmp_path}/adj", f"{tmp_path}/parts")
        assert {r.vid: r.part_id for r in v2.collect()} == {i: i % 4 for i in range(n)}
        files = writers.convert_to_partitions(spark, f"{tmp_path}/adj", f"{tmp_path}/parts", f"{tmp_path}/local")
        assert len(files) == 4 and plain(*readers.read_graph(spark, "ladjp", f"{tmp_path}/local")) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blank_lines_of_adj(spark, tmp_path):
    (tmp_path / "g").write_text("4 1 011\n3 4 1\n\n2\n5 1 1\n\n\n")
    v, e = readers.read_graph(spark, "adj", str(tmp_path / "g"))
    assert plain(v, e) == ({0: 2, 1: 0, 2: 1, 3: 4}, {(0, 3, 0)})
