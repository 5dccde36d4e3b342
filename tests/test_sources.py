"""Typed scans, exports, file pins and the ingest jobs."""

from __future__ import annotations

import gzip
import hashlib
from datetime import datetime

import pytest

from tidewatch.catalog import registry, scan_queries  # noqa: F401
from tidewatch.config import IngestConfig
from tidewatch.errors import DataQualityError
from tidewatch.plans import ingest
from tidewatch.session import replace_table, swap_folders
from tidewatch.sources import chained, files, manifest, schemas

HEADER = (
    "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,"
    "Amount Paid,Payment Currency,Payment Format,Is Laundering"
)
ROWS = [
    "2022/09/01 00:20,010,A,010,A,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0",
    "2022/09/01 00:26,011,B,010,A,0.01,US Dollar,0.01,US Dollar,Cheque,1",
    "2022/09/02 10:00,010,A,011,C,12.5,Euro,13.75,US Dollar,ACH,0",
]


def pins_of(folder):
    return {
        p.name: {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()}
        for p in folder.iterdir()
    }


@pytest.fixture()
def bank(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "HI-Small_Trans.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    names = "\n".join(f"Bank {x},01{i},{x},E{x},Entity {x}" for i, x in enumerate("ABC"))
    (raw / "HI-Small_accounts.csv").write_text(f"Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n{names}\n")
    pins = {"datasets": {"hi-small": {"files": pins_of(raw)}}}
    cfg = IngestConfig(bank_min_tx=3, bank_min_accounts=3, flagged_rate=1 / 3, flagged_count=1)
    return raw, tmp_path / "store", pins, cfg


def test_bank_ingest(spark, bank):
    raw, store, pins, cfg = bank
    report = ingest.ingest_bank(spark, str(raw), str(store), pins, cfg)
    assert {r["passed"] for r in report.collect()} == {True}
    tx = spark.read.parquet(f"{store}/bank_transaction")
    first = tx.orderBy("tx_time").first()
    assert first["tx_time"] == datetime(2022, 9, 1, 0, 20) and first["from_bank"] == "010"
    assert dict(tx.dtypes)["amount_paid"] == "double" and dict(tx.dtypes)["is_laundering"] == "smallint"
    before = files.content_hash(tx).first()
    ingest.ingest_bank(spark, str(raw), str(store), pins, cfg)
    again = spark.read.parquet(f"{store}/bank_transaction")
    assert again.count() == 3 and files.content_hash(again).first() == before


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"bank_min_tx": 4}, "transactions"), ({"bank_min_accounts": 4}, "distinct_accounts"),
        ({"flagged_count": 2}, "flagged_count"), ({"flagged_rate": 0.5}, "flagged_rate"),
    ],
)
def test_a_failed_gate_leaves_no_output(spark, bank, change, message):
    raw, store, pins, cfg = bank
    from dataclasses import replace

    with pytest.raises(DataQualityError, match=message):
        ingest.ingest_bank(spark, str(raw), str(store), pins, replace(cfg, **change))
    assert not store.exists()


def test_changed_files_are_refused(spark, bank):
    raw, store, pins, cfg = bank
    path = raw / "HI-Small_Trans.csv"
    text = path.read_text()
    path.write_text(text.replace("0.01", "0.02"))
    with pytest.raises(DataQualityError, match="checksum"):
        ingest.ingest_bank(spark, str(raw), str(store), pins, cfg)
    path.write_text(text + "\n")
    with pytest.raises(DataQualityError, match="size"):
        ingest.ingest_bank(spark, str(raw), str(store), pins, cfg)
    assert not store.exists()


def test_pins_and_their_comparison(spark, bank):
    raw, _, pins, _ = bank
    with pytest.raises(DataQualityError, match="no files"):
        manifest.pins_from_manifest(spark, pins, "other")
    with pytest.raises(DataQualityError, match="lack a pin"):
        manifest.pins_from_manifest(spark, {"datasets": {"x": {"files": {"f": {"bytes": 1}}}}}, "x")
    frame = manifest.pins_from_manifest(spark, pins, "hi-small")
    found = manifest.hash_files(spark, f"{raw}/*")
    gone = spark.createDataFrame([("absent.csv", 1, "x")], manifest.PIN_SCHEMA)
    assert {r["status"] for r in manifest.check_files(gone, found).collect()} == {"missing"}
    compared = manifest.compare_manifests(frame.filter("file LIKE '%Trans%'").unionByName(gone), found)
    assert {r["file"]: r["status"] for r in compared.collect()} == {
        "absent.csv": "absent", "HI-Small_Trans.csv": "same", "HI-Small_accounts.csv": "new",
    }


def test_bad_values_fail_the_scan(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(f"{HEADER}\n{ROWS[0].replace('3697.34', 'many')}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|NumberFormat"):
        files.scan_csv(spark, str(path), schemas.BANK_TX_RAW, header=True).collect()
    path.write_text(f"{HEADER}\n{ROWS[0].replace('2022/09/01', '2022-09-01')}\n")
    with pytest.raises(Exception, match="CANNOT_PARSE|parse"):
        files.bank_transactions(files.scan_csv(spark, str(path), schemas.BANK_TX_RAW, header=True)).collect()


def test_missing_tables_are_listed_together(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "one"))
    with pytest.raises(DataQualityError, match="three .*hint c.*two .*hint b"):
        files.open_tables(spark, str(tmp_path), {"one": "a", "two": "hint b", "three": "hint c"})


def test_content_hash_sees_duplicates(spark):
    frame = spark.range(5)
    doubled = frame.unionByName(spark.range(2)).unionByName(spark.range(2))
    assert files.content_hash(frame).first() != files.content_hash(doubled).first()
    assert files.content_hash(frame).first() == files.content_hash(frame.repartition(3)).first()


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    contents = {"small.csv": b"ab" * 10, "large.csv": bytes(range(256)) * 40, "two words.bin": b"x" * 5000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = manifest.hash_files(spark, f"{tmp_path}/*", record_bytes=100, block_bytes=7)
    want = {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    assert {tuple(r) for r in found.collect()} == want


def digests_of(folder):
    return {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in folder.iterdir()}


def test_no_task_reads_more_than_a_part(spark, tmp_path, monkeypatch):
    sizes = {
        "prime.bin": 100_003, "whole parts.bin": 8192, "part and a byte.bin": 4097, "a,b{c}[d].bin": 5000,
        "back\\slash.bin": 4500, "record.bin": 4096, "blocks.bin": 4096 + 3 * 64, "slop.bin": 4505,
    }
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(hashlib.shake_128(name.encode()).digest(size))
    read, one_round = [], chained._round

    def counted(spark, blocks, turn, single):
        before = {index: chain.at for index, chain in turn.items()}
        one_round(spark, blocks, turn, single)
        read.extend(chain.at - before[index] for index, chain in turn.items())

    monkeypatch.setattr(chained, "_round", counted)
    found = manifest.hash_files(spark, f"{tmp_path}/*", record_bytes=4096, block_bytes=64, part_bytes=4096)
    assert {tuple(r) for r in found.collect()} == digests_of(tmp_path)
    assert max(read) == 4096 and sum(read) == sum(n for n in sizes.values() if n > 4096)


@pytest.mark.parametrize("query", ["s11_file_manifest_verify", "s12_file_manifest_drift"])
def test_manifest_queries_read_large_tables_in_parts(spark, tmp_path, monkeypatch, query):
    settings = {key: spark.conf.get(key, None) for key in registry.TABLE_CONF}
    for name in ("nation", "region"):
        (tmp_path / f"{name}.parquet").write_bytes(name.encode())
    with open(tmp_path / "lineitem.parquet", "wb") as stream:
        stream.truncate(150_000_001)
    read, one_round = [], chained._round

    def counted(spark, blocks, turn, single):
        before = {index: chain.at for index, chain in turn.items()}
        one_round(spark, blocks, turn, single)
        read.extend(chain.at - before[index] for index, chain in turn.items())

    monkeypatch.setattr(chained, "_round", counted)
    rows = registry.QUERIES[query](spark, str(tmp_path)).collect()
    for key, value in settings.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    drift = {"nation.parquet": "drifted", "region.parquet": "new", "lineitem.parquet": "same"}
    want = drift if query.startswith("s12") else dict.fromkeys(drift, "ok")
    assert {r["file"]: r["status"] for r in rows} == want
    assert {(r["file"], r["sha256"]) for r in rows} == {(n, h) for n, _, h in digests_of(tmp_path)}
    assert max(read) == 1 << 26 and sum(read) % 150_000_001 == 0


def test_large_files_are_read_through_spark(spark, tmp_path):
    """A store that only Hadoop knows."""
    for name, size in {"small.bin": 90, "large.bin": 5003}.items():
        (tmp_path / name).write_bytes(hashlib.shake_128(name.encode()).digest(size))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.pins.link./in", f"file://{tmp_path}")
    found = manifest.hash_files(spark, "viewfs://pins/in/*", record_bytes=100, block_bytes=64)
    assert {tuple(r) for r in found.collect()} == digests_of(tmp_path)


@pytest.mark.parametrize("limit", [100, 1 << 30])
def test_packed_files_are_hashed_as_they_are(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(manifest, "PACKED_BYTES", limit, raising=False)
    (tmp_path / "a [1].csv.gz").write_bytes(gzip.compress(hashlib.shake_128(b"x").digest(3000)))
    (tmp_path / "b.csv").write_bytes(b"plain" * 100)
    found = manifest.hash_files(spark, f"{tmp_path}/*", record_bytes=100)
    assert {tuple(r) for r in found.collect()} == digests_of(tmp_path)


def test_without_a_state_to_hand_on_files_are_hashed_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "large.bin").write_bytes(b"plain" * 1000)
    monkeypatch.setattr(chained, "can_chain", lambda: False)
    found = manifest.hash_files(spark, f"{tmp_path}/*", record_bytes=100)
    assert {tuple(r) for r in found.collect()} == digests_of(tmp_path)


def test_a_file_that_changes_is_refused(spark, tmp_path):
    path = tmp_path / "large.bin"
    path.write_bytes(b"x" * 5000)
    for length in (4000, 6000, 9000):
        with pytest.raises(DataQualityError, match="changed"):
            chained.chained_digests(spark, {f"file:{path}": length}, 4096, 64)


class FailingStore:
    """A file system whose second rename fails or raises."""

    def __init__(self, store, error):
        self.store, self.error, self.renames = store, error, 0

    def rename(self, a, b):
        self.renames += 1
        if self.renames == 2:
            if self.error:
                raise self.error
            return False
        return self.store.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.store, name)


@pytest.mark.parametrize("error", [None, OSError("lost")])
def test_a_failed_rename_leaves_the_old_table(spark, tmp_path, error):
    old, new = f"{tmp_path}/t", f"{tmp_path}/t.new"
    assert replace_table(spark.range(3), old).count() == 3
    spark.range(5).write.parquet(new)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    paths = [hadoop.Path(p) for p in (new, old, f"{old}.old")]
    store = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with pytest.raises(OSError):
        swap_folders(FailingStore(store, error), *paths)
    assert spark.read.parquet(old).count() == 3 and spark.read.parquet(new).count() == 5
    assert replace_table(spark.range(7), old).count() == 7
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.new"]
