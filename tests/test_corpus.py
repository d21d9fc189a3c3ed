from __future__ import annotations

import pytest

from textloom.plans.corpus import Corpus
from textloom.streaming.reconcile import Reconciler

SOURCES = {
    "a.ts": "import './b'\nimport './hub'\nexport const common = 1\nexport const shared = 2\n",
    "b.ts": "import './c'\nexport const common = 1\n",
    "c.ts": "import './a'\nexport const common = 1\n",
    "d.ts": "import './hub'\nexport const hubhelper = 1\n",
    "e.ts": "export const alone = 1\n",
    "hub.ts": "export const shared = 1\n",
    "_u/__init__.py": "class Under: pass\n",
    "node_modules/x.ts": "export const hidden = 1\n",
    "data.json": '{"k1": 1, "k2": [2], "k3": "x"}',
}


@pytest.fixture
def corpus(spark, tmp_path):
    for name, text in SOURCES.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return Corpus(spark, str(tmp_path / "root"), str(tmp_path / "cache"))


def test_golden_tree(spark, corpus, tmp_path):
    first = corpus.refresh()
    assert first["added"] == 8 and first["failed_files"] == 0
    assert corpus.refresh()["rescanned"] == 0  # a clean round
    assert [r["file"] for r in corpus.hotspots()["rows"]] == ["hub.ts", "a.ts", "c.ts", "b.ts"]
    assert [r["file"] for r in corpus.orphans()["rows"]] == ["_u/__init__.py", "data.json", "e.ts"]
    assert [r["file"] for r in corpus.find_symbols("common")["rows"]] == ["a.ts", "b.ts", "c.ts"]
    assert [r["file"] for r in corpus.find_symbols("common", ranking=True)["rows"]] == ["a.ts", "c.ts", "b.ts"]
    boosted = corpus.find_symbols("common", ranking=True, boost=[str(tmp_path / "root" / "b.ts")])
    assert boosted["rows"][0]["file"] == "b.ts" and boosted["total"] == 3
    assert corpus.find_symbols("hidden")["total"] == 0 and corpus.find_symbols("Under")["total"] == 1
    limited = corpus.find_symbols("common", limit=1)
    assert limited["total"] == 3 and limited["spill_count"] == 2 and spark.read.json(limited["spill_path"]).count() == 2
    assert [r["from"] for r in corpus.edges("hub.ts", "in")["rows"]] == ["a.ts", "d.ts"]
    assert corpus.edges("../outside.ts", "out")["total"] == 0
    assert corpus.files("HUB")["total"] == 1
    assert corpus.cost_probe("common")["hits"] == 3
    page = corpus.read_json("data.json", limit=2)
    assert [e["key"] for e in page["entries"]] == ["k1", "k2"]
    assert corpus.read_json("data.json", cursor=page["next_cursor"])["entries"][0]["key"] == "k3"
    assert corpus.read_slice("a.ts", find="HUB", context_before=2, length=5)["snippet"] == "./hub"
    with pytest.raises(ValueError):
        corpus.read_slice("../x")


def test_incremental_equals_full(spark, corpus, tmp_path):
    corpus.refresh()
    root = tmp_path / "root"
    (root / "b.ts").write_text("import './late'\nexport const renamed = 1\n")
    (root / "hub.ts").unlink()
    report = corpus.refresh()
    assert (report["added"], report["rescanned"], report["dropped"]) == (0, 1, 1)
    (root / "late.ts").write_text("export const late = 1\n")
    corpus.refresh()  # b.ts is not read again, but its edge finds the new file
    other = Corpus(spark, str(root), str(tmp_path / "cache2"))
    for name in ("symbols", "edges", "graph"):
        rows = [sorted(map(str, c.tables()[name].collect())) for c in (corpus, other)]
        assert rows[0] == rows[1]
    status = corpus.status()
    assert status["files"] == 8 and status["pending_files"] == 0 and status["corrupt_lines"] == 0 and len(status["history"]) == 3


def test_a_damaged_index_is_built_anew(spark, corpus, tmp_path):
    corpus.refresh()
    folder = next((tmp_path / "cache").glob("index-*"))
    (folder / "current.json").write_text("{")
    assert corpus.store.meta() == (None, "corrupt")
    assert corpus.refresh()["added"] == 8


def test_measuring(spark, corpus):
    call = corpus.measure("slice", corpus.read_slice, lambda out: out["total_bytes"])
    call("a.ts", length=4)
    with pytest.raises(ValueError):
        call("../x")
    got = corpus.savings()
    assert (got["aggregate"]["calls"], got["aggregate"]["failures"]) == (2, 1)
    corpus.measured = False
    assert corpus.measure("slice", call, lambda out: 0) is call


def test_retention(spark, corpus, monkeypatch):
    from textloom.plans import corpus as module

    monkeypatch.setattr(module, "HISTORY_ROWS", 2)
    monkeypatch.setattr(module, "LEDGER_ROWS", 1)
    call = corpus.measure("slice", corpus.read_slice, lambda out: out["total_bytes"])
    for _ in range(3):
        corpus._append_history({"scanned_bytes": 1, "symbols": 1, "scan_errors": []}, 5)
        call("a.ts")
    assert corpus.compact() == {"history": 1, "ledger": 2}
    assert corpus.history()[0].count() == 2 and corpus.ledger()[0].count() == 1 and corpus.compact() == {"history": 0, "ledger": 0}


def test_reconciler(spark, corpus, tmp_path):
    rounds = Reconciler([corpus])
    query = rounds.start(spark, str(tmp_path / "stream"), every_ms=5000)
    try:
        for _ in range(300):
            if rounds.done >= 0:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert rounds.reports[corpus.root]["added"] == 8
    before = dict(rounds.reports)
    rounds.round(None, 0)  # the same batch again
    assert rounds.reports == before


def test_reads_no_more_of_a_file_than_it_needs(spark, corpus, tmp_path):
    reads = []

    def read(path, start, stop):
        with open(path, "rb") as f:
            f.seek(start)
            reads.append(stop - start)
            return f.read(stop - start)

    own = Corpus(spark, corpus.root, corpus.cache, read=read)
    (tmp_path / "root" / "big.json").write_text("{" + ",".join(f'"k{i}": {i}' for i in range(100_000)) + "}")
    first = own.read_json("big.json", limit=2)
    assert [e["key"] for e in first["entries"]] == ["k0", "k1"] and first["scanned_bytes"] < 100 and sum(reads) <= 1 << 16
    reads.clear()
    assert own.read_json("big.json", cursor=first["next_cursor"], limit=2)["entries"][0]["key"] == "k2" and sum(reads) <= 1 << 16
    reads.clear()
    size = (tmp_path / "root" / "big.json").stat().st_size
    assert own.read_slice("big.json", start=size - 10, length=10)["snippet"].endswith("}") and sum(reads) <= 200_000
    stopped = own.read_json("big.json", limit=1000, cancelled=lambda: True)
    assert (stopped["validation"], stopped["entries"]) == ("cancelled", [])
    assert own.read_slice("big.json", find="k99999", cancelled=lambda: True)["search_status"] == "cancelled"


def test_a_cancelled_refresh_leaves_the_index(spark, corpus, tmp_path):
    from textloom.sources.index_store import Cancelled

    corpus.refresh()
    before = corpus.store.meta()
    (tmp_path / "root" / "new.ts").write_text("export const late = 1\n")
    asked = iter([False, False, True])
    with pytest.raises(Cancelled):
        corpus.refresh(cancelled=lambda: next(asked))
    assert corpus.store.meta() == before and len(list((tmp_path / "cache").glob("index-*/g*"))) == 1
    with corpus._lock, pytest.raises(Cancelled):
        corpus.refresh(cancelled=lambda: True)
    assert corpus.refresh()["added"] == 1
    for k in range(3):
        (tmp_path / "root" / "new.ts").write_text(f"export const late = {k}{k}\n" * (k + 1))
        corpus.refresh()
    assert len(list((tmp_path / "cache").glob("index-*/g*"))) == 2  # the current generation and the one before it
    assert "cancelled" in (tmp_path / "cache" / "textloom.log").read_text()


def test_an_index_that_breaks_its_rules_is_built_anew(spark, corpus):
    corpus.refresh()
    tables = corpus.store.load(corpus.fingerprint)[0]
    bad = tables["files"].unionByName(spark.createDataFrame([("../x.ts", 1.0, 1, False)], tables["files"].schema))
    stray = tables["symbols"].unionByName(spark.createDataFrame([("n", "gone.ts", 1, "const", "c", 0)], tables["symbols"].schema))
    corpus.store.commit(tables | {"symbols": stray}, corpus.fingerprint, corpus.root, 1)
    got, _, state = corpus.store.load(corpus.fingerprint)
    assert state == "ok" and got["symbols"].where("file = 'gone.ts'").count() == 0  # symbols of unknown files go
    corpus.store.commit(tables | {"files": bad}, corpus.fingerprint, corpus.root, 1)
    assert corpus.store.load(corpus.fingerprint)[2] == "corrupt"
    assert corpus.refresh()["added"] == 8 and corpus.status()["consistent"]


def test_savings_spill_what_is_older(spark, corpus):
    call = corpus.measure("slice", corpus.read_slice, lambda out: out["total_bytes"], defaults={"length": 9}, relevant={"length"})
    call("a.ts", length=4)
    call("a.ts")
    call("a.ts", length=9)
    got = corpus.savings(root=corpus.root + "/../" + corpus.root.rsplit("/", 1)[1], recent=1)
    assert (got["aggregate"]["calls"], got["aggregate"]["dup_calls"], len(got["recent"]), got["spill_count"]) == (3, 1, 1, 2)


def test_the_log_is_trimmed(corpus, tmp_path, monkeypatch):
    from textloom.plans import corpus as module

    monkeypatch.setattr(module, "LOG_BYTES", 1000)
    for k in range(100):
        corpus.log(f"line {k}")
    lines = (tmp_path / "cache" / "textloom.log").read_text().splitlines()
    assert lines[-1].endswith("line 99") and len(lines) < 40 and all("line " in x for x in lines)
