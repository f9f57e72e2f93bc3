"""Lines of growing files: cut anywhere, half written, replaced, and as a stream."""

import io
import random

import pytest

from mnemospark.sources import lines
from mnemospark.storage import shared_folder
from mnemospark.streaming import tail


def whole(data):
    """(offset, line) of the finished lines."""
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        out.append((at, line))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_ranges_cut_anywhere_hold_each_line_once(monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng = random.Random(7)
    for _ in range(60):
        data = b"".join(rng.choice([b"\n", b"a", "é".encode(), b"long" * 9, b"\r\n"]) for _ in range(rng.randrange(30)))
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(9)))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in lines.lines(io.BytesIO(data), a, b)]
        assert got == whole(data)


def test_batch(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"k":1}\n\n\xff\r\n' + b"x" * 3_000_000 + b"\nhalf")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "b.jsonl").write_bytes(b"hidden\n")
    (tmp_path / "c.txt").write_bytes(b"other\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.jsonl").write_bytes(b"deep\n")
    got = lines.read(spark, f"file://{tmp_path}", pattern="*.jsonl", splitBytes=1_000_000)
    rows = {(r.file[len(str(tmp_path)) + 1 :], r.offset): r.line for r in got.collect()}
    assert rows == {("a.jsonl", 0): '{"k":1}', ("a.jsonl", 8): "", ("a.jsonl", 9): "�", ("a.jsonl", 12): "x" * 3_000_000, ("deep/d.jsonl", 0): "deep"}
    assert lines.read(spark, f"file://{tmp_path}/c.txt").first().line == "other"
    assert lines.read(spark, f"file:{tmp_path}/none").count() == 0


def test_filters_leave_files_out(tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(b"1\n")
    reader = lines.TailedLines({"path": str(tmp_path)}).reader(None)
    rest = list(reader.pushFilters([lines.EqualTo(("file",), f"{tmp_path}/b"), lines.EqualTo(("line",), "1")]))
    assert [f.attribute for f in rest] == [("line",)] and [p.file for p in reader.partitions()] == [f"{tmp_path}/b"]


def test_stream_over_a_file_that_grows_in_mid_line(spark, tmp_path):
    """Each line comes once, with the batch after its end was written; a rerun without news gives nothing."""
    folder, base = tmp_path / "log", shared_folder(spark)
    folder.mkdir()
    batches = []

    def keep(batch, number):
        batches.append(sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in batch.collect()))

    def run():
        batches.clear()
        tail.drain(lines.stream(spark, f"file://{folder}", splitBytes=4), f"{base}/checkpoint", keep)
        return sum(batches, [])

    with (folder / "a").open("ab") as f:
        f.write(b"one\ntw")
    assert run() == [("a", 0, "one")]
    assert run() == []
    with (folder / "a").open("ab") as f:
        f.write(b"o, and mo")
    (folder / "b").write_bytes(b"new\n")
    assert run() == [("b", 0, "new")]
    with (folder / "a").open("ab") as f:
        f.write("re é\nthree\n".encode())
    assert run() == [("a", 4, "two, and more é"), ("a", 21, "three")]
    (folder / "a").write_bytes(b"short\n")
    assert run() == []
    with (folder / "a").open("ab") as f:
        f.write(b"on\n")
    assert run() == [("a", 6, "on")]
