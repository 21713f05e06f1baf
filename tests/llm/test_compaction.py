"""Compaction of files: packing against first fit by hand, results against rows sorted and packed in plain Python."""

import hashlib
import json
import math
import os
import random
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from docfathom.llm import compaction
from docfathom.llm.queries import QUERIES


def first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_pack(seed):
    r = random.Random(seed)
    sizes = [r.randint(0 if seed % 3 else 1, r.choice([3, 10, 60])) for _ in range(r.randint(0, 300))]
    if seed % 2:
        sizes.sort(reverse=True)
    capacity = r.choice([60, 75, 200])
    assert compaction.pack(sizes, capacity) == first_fit(sizes, capacity)


def rows_of(n, days, seed=0):
    r, at = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for k in range(n):
        day = 0 if r.random() < 0.4 else r.randrange(days)
        moment = at + timedelta(days=day, seconds=r.randrange(86_400)) if k % 50 else None
        out.append((k if k % 97 else None, moment, r.choice([None, 1.005, -3.335, float("nan"), 12.0]), "x" * (k % 5), k))
    return out + out[: n // 20]


SCHEMA = "click_id long, arrived_at timestamp_ntz, value double, day string, lot long"


def expected(rows):
    share = lambda x: 1 + len(rows) // x
    by_day = {}
    for r in rows:
        by_day.setdefault(None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days, []).append(r)
    out = {}
    for day, held in by_day.items():
        files = {}
        for r in held:
            h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            files.setdefault((h // 16 % (1 + len(held) // share(200)), min(h % 4, h // 4 % 4)), []).append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] is not None, r[1] or datetime(1970, 1, 1), r[0] is not None, r[0] or 0))
        few = sorted((k for k in files if len(files[k]) < share(750)), key=lambda k: (-len(files[k]), k))
        groups = {}
        for k, g in zip(few, first_fit([len(files[k]) for k in few], share(300)), strict=True):
            groups.setdefault(g, []).append(k)
        for members in [*groups.values(), *([k] for k in files if k not in few)]:
            whole = [r for k in members for r in files[k]]
            ids = [r[0] for r in whole if r[0] is not None]
            cents = sum(0 if r[2] is None or math.isnan(r[2]) else math.floor(100 * r[2] + 0.5) for r in whole)
            sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in whole).encode()).hexdigest()
            out[(day, *members[0])] = (len(whole), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in members), sha, len(members) > 1)
    return out


@pytest.mark.parametrize("n,days", [(0, 1), (1, 1), (900, 4), (4000, 9)])
def test_query(spark, tmp_path, n, days):
    rows = rows_of(n, days)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    got = QUERIES["op13_compaction"](spark, str(tmp_path)).collect()
    assert {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in got} == expected(rows)
    assert all(r.columns == "click_id,arrived_at,value,day,lot" for r in got)
    if got:
        folder = os.path.dirname(got[0].path)
        assert sorted(r.path for r in got) == sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet"))
        for r in got:
            table = pq.ParquetFile(r.path).read()
            text = ",".join("" if i is None else str(i) for i in table.column("click_id").to_pylist())
            assert hashlib.sha256(text.encode()).hexdigest() == r.ids_sha256 and ",".join(table.schema.names) == r.columns
        every = sorted((str(x) for r in got for x in zip(*pq.ParquetFile(r.path).read().to_pydict().values(), strict=True)))
        assert every == sorted(str(r) for r in rows)


def test_untouched_files_and_a_driver_that_is_lost(spark, tmp_path, monkeypatch):
    """Files outside groups keep their bytes; what is left of a journal is carried out later, once."""
    spark.createDataFrame(rows_of(1500, 5), SCHEMA).write.parquet(f"{tmp_path}/clicks.parquet")
    done = compaction.finish
    before = {}

    def lost(spark, staging):
        if staging.endswith("second"):
            folder = f"{tmp_path}/to/clicks"
            before.update({f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".parquet")})
            journal = json.loads(open(f"{staging}.journal").read())
            journal["moves"], journal["removals"] = journal["moves"][:2], []
            open(f"{staging}.half.journal", "w").write(json.dumps(journal))
            done(spark, f"{staging}.half")
        done(spark, staging)
        done(spark, staging)

    monkeypatch.setattr(compaction, "finish", lost)
    got = compaction.compact_clicks(spark.read.parquet(f"{tmp_path}/clicks.parquet"), f"{tmp_path}/to").collect()
    kept = [r for r in got if not r.rewritten]
    assert kept and len(kept) < len(got) and sum(r.n_rows for r in got) == 1575
    for r in kept:
        assert open(r.path, "rb").read() == before[os.path.basename(r.path)]
    assert all(os.path.basename(r.path) not in before for r in got if r.rewritten)
