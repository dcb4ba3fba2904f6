"""Archives that are read in many byte ranges, records that hold the magic, damage, and repeated payloads."""

import random
from collections import Counter

import pytest

from corvane.llm import warc

EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\na\r\n\r\nWARC/1.1\r\nContent-Length: 900\r\n\r\nzz\r\n\r\n"
SPLIT = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(pages):
    first = {}
    for i, _, html in pages:
        h = (html or "").encode()
        first[h] = min((x for x in (i, first.get(h)) if x is not None), default=None)
    return Counter((i, len((html or "").encode()), warc.payload_digest((html or "").encode()), *(("revisit", first[h]) if first[h] is not None and first[h] != i else ("response", None))) for i, _, html in pages for h in [(html or "").encode()])


def rows(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("seed", range(3))
def test_archives_of_many_ranges(spark, small_ranges, seed, monkeypatch):
    monkeypatch.setattr(warc, "PART", 3)
    r = random.Random(seed)
    bodies = ["", EVIL, EVIL * 40, "a" * 5_000, "WARC/1.1\r\n" * 400, "\r\n" * 300, ("p" * 70 + "\r\nWARC/1.0\r\nContent-Length: 5000\r\n\r\n") * 60, "é🎉" * 900]
    pages = [(i, r.choice(["u", None, "http://a/" + "x" * 100_000 if i == 7 else "v"]), r.choice([*bodies, f"own {i} " * r.randrange(400)])) for i in range(120)]
    pages += [(None, "n", EVIL * 40), (3, "again", pages[3][2])]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), archive_records=50)
    assert rows(got) == plain(pages)


def test_damage_in_the_middle_is_an_error(spark, small_ranges, tmp_path):
    parts = [warc.record(i, "u", b"payload " * 60, None, "d") for i in range(40)]
    for k, bad in enumerate([parts[20][:-9] + parts[20][-8:], parts[20].replace(b"Content-Length: 5", b"Content-Length: 4", 1), b"", parts[20][:30] + b"\r\n"]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc").write_bytes(b"".join([*parts[:20], bad, *parts[21:]]))
        (tmp_path / str(k) / "b.warc").write_bytes(b"".join(parts[:3]))
        read = lambda k=k: warc.read_archives(spark, str(tmp_path / str(k)), warc.Scratch(spark, "warc")).count()
        if bad:
            with pytest.raises(ValueError, match="1 archives"):
                read()
        else:
            assert read() == 42


def test_every_cut_of_an_archive(spark, small_ranges, tmp_path):
    parts = [warc.record(i, "u", EVIL.encode() * 9, None, "d") for i in range(3)]
    two, want = b"".join(parts), {}
    for n in sorted({len(two) - k for k in range(14)} | set(range(2 * len(parts[0]) - 5, 2 * len(parts[0]) + 14))):
        (tmp_path / f"{n}.warc").write_bytes(two[:n])
        want[n] = sum(n >= len(b"".join(parts[:k])) for k in (1, 2, 3))
    got = warc.read_archives(spark, str(tmp_path), warc.Scratch(spark, "warc"))
    assert got.count() == sum(want.values())


def test_gzip_archives(spark, tmp_path):
    import gzip

    parts = [warc.record(i, "u", EVIL.encode() * 9, None, "d") for i in range(9)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path), warc.Scratch(spark, "warc")).collect()) == list(range(9))


def test_tree_of_pointers():
    r = random.Random(2)
    for _ in range(200):
        begin = sorted(r.sample(range(60), r.randint(0, 25)))
        next_ = [b + r.randint(1, 12) for b in begin]
        leaves, low, high = warc._tree(begin, next_)
        step = dict(zip(begin, next_, strict=True))
        for i, b in enumerate(begin):
            passed, at = set(), b
            while at in step:
                passed.add(at)
                at = step[at]
            assert at == leaves[i]
            assert {begin[j] for j in range(len(begin)) if low[j] <= low[i] < high[j]} == passed
