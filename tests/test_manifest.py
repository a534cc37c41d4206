"""Checksums of files in ranges, put together as a tree."""

import hashlib

from silverbrook.operators import export


def plain(data, piece, fan):
    level = [hashlib.sha256(data[at:at + piece]).hexdigest() for at in range(0, max(1, len(data)), piece)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[at:at + fan]).encode()).hexdigest() for at in range(0, len(level), fan)]
    return level[0]


def test_roots_do_not_depend_on_other_files(spark, tmp_path):
    sizes = (0, 1, 999, 1000, 1001, 3000, 3001, 9000, 9001, 27_500)
    files = {f"sub dir/f {n}.bin": bytes((i * 7 + n) % 251 for i in range(n)) for n in sizes}
    (tmp_path / "sub dir").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.n_bytes, r.sha256) for r in export.manifest(spark, str(tmp_path), piece=1000, fan=3).collect()}
    one = export.manifest(spark, str(tmp_path), "f 9000.bin", piece=1000, fan=3).collect()
    assert [(r.path, r.sha256) for r in one] == [("sub dir/f 9000.bin", got["sub dir/f 9000.bin"][1])]
    empty = files.pop("sub dir/f 0.bin")
    assert got.pop("sub dir/f 0.bin", None) is None and empty == b""  # not listed
    assert got == {n: (len(d), plain(d, 1000, 3)) for n, d in files.items()}
    whole = {r.path: r.sha256 for r in export.manifest(spark, str(tmp_path)).collect()}
    assert whole == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}


def test_one_changed_byte_of_a_file_above_two_gigabytes(spark, tmp_path):
    big, other = tmp_path / "a" / "big", tmp_path / "b" / "big"
    for path in (big, other):
        path.parent.mkdir()
        with path.open("wb") as f:  # a hole takes no disk
            f.truncate((2 << 30) + 12_345)
    with other.open("r+b") as f:
        f.seek(2 << 30)
        f.write(b"x")
    before, after = (export.manifest(spark, str(p.parent)) for p in (big, other))
    assert before.first().n_bytes == (2 << 30) + 12_345
    assert [(r.path, r.change) for r in export.manifest_diff(before, after).collect()] == [("big", "changed")]
    assert export.manifest_diff(before, export.manifest(spark, str(big.parent))).count() == 0


def test_no_files(spark, tmp_path):
    assert export.manifest(spark, str(tmp_path)).collect() == []
