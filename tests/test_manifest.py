"""File manifests: large files are read in pieces and have the MD5 of the whole."""

import gzip
import hashlib
import random

from tidemark.sources import files

MOST = "spark.sql.sources.binaryFile.maxLength"


def test_large_files_in_pieces(spark, tmp_path, monkeypatch):
    noise = random.Random(1).randbytes(90_000)
    made = {
        "noise.bin": noise,
        "sub dir/a b%41.bin": files.MARK + noise[:40_000] + b"\n",
        "marks.bin": files.MARK + files.MARK + b"\r\n\n" * 9000,
        "ends.bin": b"\n" * 20_000,
        "no_end.bin": b"one line\r" * 4000,
        "packed.gz": gzip.compress(noise[:4000]),
        "small.bin": files.MARK + b"x\n",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "PIECES_FROM", 3000)
    monkeypatch.setattr(files, "PIECE", 700)
    before = {k: spark.conf.get(k) for k in (MOST, "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key, value in zip(before, ("5000", "1500", "0"), strict=True):
            spark.conf.set(key, value)
        rows = files.file_manifest(spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    found = {r.path.split(f"{tmp_path}/")[1]: (r.size, r.md5) for r in rows}
    assert len(rows) == len(found)
    assert found == {name: (len(data), hashlib.md5(data).hexdigest()) for name, data in made.items()}
