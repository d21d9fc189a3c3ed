from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import extract, json_keys, scalar, slices


def test_lines_survive_carriage_returns_and_multi_line_modifiers():
    text = "\r\n\r\nexport\n  async function one() {}\n\tclass Two {}\nconst three: number = 1\n"
    assert [(n, line, k) for n, line, k, _ in extract.find_symbols(text, ".ts")] == [("one", 4, "function"), ("Two", 5, "class"), ("three", 6, "const")]


def test_families_differ():
    assert [k for _, _, k, _ in extract.find_symbols("func (r *R) A() {}\ntype B struct {}", ".go")] == ["func", "type"]
    assert [(n, k) for n, _, k, _ in extract.find_symbols("pub(crate) async fn a() {}\npub enum E {}", ".rs")] == [("a", "fn"), ("E", "type")]
    assert [n for n, *_ in extract.find_symbols("public static function f() {}\nabstract class C", ".php")] == ["f", "C"]
    assert list(extract.find_symbols("x = 1", ".py")) == []


def test_imports_in_all_forms():
    text = "import a from './a'\nimport './b'\nimport {\n c\n} from \"./c\"\nexport * from './d'\nexport { e } from './e'\nconst f = import( './f' )\nrequire('./g')\nimport a2 from './a'; import('./a')\n"
    assert [(s, n) for s, n, _ in extract.find_imports(text, ".ts")] == [("./a", 1), ("./b", 2), ("./c", 3), ("./d", 6), ("./e", 7), ("./f", 8), ("./g", 9), ("./a", 10)]
    assert extract.find_imports("from .x import y\nimport os, sys\n", ".py") == [(".x", 1, "from .x import y"), ("os,", 2, "import os, sys")]
    assert extract.find_imports('import "fmt"', ".go") == []


def pick(file, spec, files):
    status, candidates = extract.targets(file, spec)
    return status or next((c for c in candidates if c in files), "unresolved")


@pytest.mark.parametrize("file, spec, expected", [
    ("src/a.ts", "./b.js", "src/b.ts"), ("src/a.js", "./b.js", "src/b.js"), ("src/a.ts", "./dir", "src/dir/index.ts"), ("src/a.ts", "../top", "top.tsx"),
    ("src/a.ts", "./v1.2", "src/v1.2/index.js"), ("src/a.ts", "@/x", "unresolved"), ("src/a.ts", "react", "external"), ("src/a.ts", "../../x", "outside"),
    ("src/a.mts", "./m.mjs", "src/m.mts"), ("src/a.ts", ".", "src/index.ts"), ("p/a.py", ".h", "p/h.py"), ("p/q/a.py", "..h", "p/h.py"), ("p/a.py", "p.q", "p/q/__init__.py"),
    ("p/a.py", ".", "unresolved"), ("p/a.py", "os", "unresolved"), ("p/a.py", "a,", "unresolved"),
])
def test_resolution(file, spec, expected):
    files = {"src/b.ts", "src/b.js", "src/dir/index.ts", "top.tsx", "src/v1.2/index.js", "src/m.mts", "src/index.ts", "p/h.py", "p/q/__init__.py"}
    assert pick(file, spec, files) == expected


def test_context_is_cut_in_utf16_units():
    assert extract.utf16_cut("a😀b", 2) == "a"
    assert extract.utf16_cut("a😀b", 3) == "a😀"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé中😀\n", max_size=80), st.integers(1, 9))
def test_pages_join_up(text, length):
    data, at, pages = text.encode(), 0, []
    while True:
        page = slices.read_slice(data, start=at, length=length)
        pages.append(page["snippet"])
        assert page["byte_offset"] == at and page["next_offset"] > at or not page["may_truncate"]
        at = page["next_offset"]
        if not page["may_truncate"]:
            break
    assert "".join(pages) == text


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAB中😀İ", max_size=60), st.text(alphabet="abAB中İ", min_size=1, max_size=4), st.integers(4, 12))
def test_literal_search_is_exact_over_chunks(text, needle, chunk):
    folded, starts = slices.folded(text)
    k = folded.find(slices.folded(needle)[0])
    expected = None if k < 0 else len(text[: max(i for i, s in enumerate(starts) if s <= k)].encode())
    found = slices.find_literal(text.encode(), needle, chunk=chunk)
    assert found.hit == expected and found.status == ("matched" if k >= 0 else "not_found")


def test_searches_keep_their_budgets():
    data = b"x" * 1000 + b"needle"
    found = slices.find_literal(data, "needle", most=1003)
    assert found.status == "byte_budget" and found.next_from == 1000
    assert slices.find_literal(data, "needle", begin=found.next_from).hit == 1000
    assert slices.find_regex(b"a" * 30 + b"!", "(a|a)*$b", budget_ms=100).status in ("time_budget", "not_found")
    runaway = slices.find_regex(b"a" * 100_000, "^(a+)+$b|(a*a*a*a*a*)*c", budget_ms=150)
    assert runaway.status == "time_budget" and runaway.hit is None
    with pytest.raises(ValueError):
        slices.find_regex(b"", "a" * 257)


def test_slices_around_hits_and_at_the_tail():
    data = "0123456789é needle tail".encode()
    around = slices.read_slice(data, find="NEEDLE", context_before=3, length=8)
    assert around["search_hit"] == 13 and around["byte_offset"] == 10 and around["snippet"].startswith("é needl")
    assert slices.read_slice(data, mode="tail", length=4)["snippet"] == "tail"
    assert slices.read_slice(data, start=99)["snippet"] == ""
    with pytest.raises(ValueError):
        slices.read_slice(b"\xff\xfe", length=2)


BAD = ["", " ", "{", "}", "[1,]", '{"a":1,}', '{"a" 1}', "{'a':1}", '{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":1e}', '{"a":+1}', '{"a":tru}', '{"a":nullx}', '{"a":1}x', '{"a":"\n"}', '{"a":"\\x"}', '{"a":"\\u12g4"}', "NaN", '{"a":[1 2]}', '{"a":{"b":1]}', "--1", '{a:1}', '{"a"}']


@pytest.mark.parametrize("text", BAD)
def test_invalid_json_is_told(text):
    assert json_keys.scan_keys(text.encode())["validation"] == "invalid"


@pytest.mark.parametrize("data", [b'{"a":"\xc0\xaf"}', b'{"a":"\xed\xa0\x80"}', b'{"\xff":1}', b'{"a":"\xf5\x80\x80\x80"}'])
def test_invalid_utf8_is_told(data):
    assert json_keys.scan_keys(data)["code"] == "invalid_utf8"


def test_keys_repeat_and_pointers_are_exact():
    text = '{ "中" : [1, {"x": "}"}], "a\\u0062":null,"中":-1.5e+3 }'
    out = json_keys.scan_keys(text.encode())
    assert [e["key"] for e in out["entries"]] == ["中", "ab", "中"] and out["total_keys"] == 3
    assert [json.loads(text.encode()[e["byte_start"] : e["byte_end"]]) for e in out["entries"]] == [[1, {"x": "}"}], None, -1500.0]


def test_random_documents_agree_with_the_platform_parser():
    rng = random.Random(5)

    def value(depth):
        k = rng.randrange(7 if depth < 3 else 5)
        return [None, True, rng.randrange(-99, 99), rng.random(), "".join(rng.choice('aé中😀"\\\n') for _ in range(rng.randrange(6))), *([[value(depth + 1) for _ in range(rng.randrange(4))], {str(i): value(depth + 1) for i in range(rng.randrange(4))}] if k > 4 else [])][k]

    for _ in range(150):
        doc = {f"k{i}": value(0) for i in range(rng.randrange(9))}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        found, cursor = {}, None
        while True:
            page = json_keys.scan_keys(text.encode(), cursor=cursor, limit=3)
            found |= {e["key"]: json.loads(text.encode()[e["byte_start"] : e["byte_end"]]) for e in page["entries"]}
            cursor = page["next_cursor"]
            if not cursor:
                break
        assert page["validation"] == "complete" and found == doc
        at = rng.randrange(len(text))
        broken = text[:at] + rng.choice('{}[],:"x1') + text[at + 1 :]
        try:
            json.loads(broken, parse_constant=lambda c: 1 / 0)
            valid = True
        except (ValueError, ZeroDivisionError):
            valid = False
        assert (json_keys.scan_keys(broken.encode(), limit=1000)["validation"] == "complete") == valid


def test_cursors_are_bound_to_file_and_secret():
    data = b'{"a":1,"b":2,"c":3}'
    cursor = json_keys.scan_keys(data, path="p", mark="m", limit=1)["next_cursor"]
    assert json_keys.scan_keys(data, path="p", mark="m", cursor=cursor)["entries"][0]["key"] == "b"
    for bad in (dict(path="q", mark="m"), dict(path="p", mark="n"), dict(path="p", mark="m", secret=b"x")):
        with pytest.raises(ValueError):
            json_keys.scan_keys(data, cursor=cursor, **bad)
    with pytest.raises(ValueError):
        json_keys.scan_keys(data, path="p", mark="m", cursor=cursor[:-3] + "abc")


def test_json_budgets_and_other_roots():
    assert json_keys.scan_keys(b"[1,2]")["code"] == "unsupported_top_level"
    deep = b'{"a":' + b"[" * 200 + b"]" * 200 + b"}"
    assert json_keys.scan_keys(deep)["validation"] == "budget_exhausted"
    assert json_keys.scan_keys(b'{"a":"' + b"x" * 5000 + b'"}', max_scan_bytes=100)["validation"] in ("budget_exhausted", "incomplete", "invalid", "complete")
    long_key = b'{"' + b"k" * 5000 + b'":1}'
    assert json_keys.scan_keys(long_key)["code"] == "key_budget_exhausted"
    entry = json_keys.scan_keys(('{"a":"' + "😀" * 300 + '"}').encode())["entries"][0]
    assert json_keys.utf16(entry["preview"]) <= 241 and entry["preview"].endswith("…")


def test_hashes_do_not_depend_on_key_order():
    assert scalar.args_hash("t", "r", {"a": 1, "b": [2, {"d": 1, "c": 2}]}) == scalar.args_hash("t", "r", {"b": [2, {"c": 2, "d": 1}], "a": 1})
    assert scalar.args_hash("t", "r", {"a": [1, 2]}) != scalar.args_hash("t", "r", {"a": [2, 1]})
    assert scalar.fingerprint("p", ["TS", ".js", "ts "], ["b", "a", ""], 1, 2) == scalar.fingerprint("p", [".js", ".ts"], ["a", "b"], 1, 2)
    assert scalar.inside_root("/r", "a\\b/../c") == "a/c" and scalar.inside_root("/r", "../x") is None
    with pytest.raises(ValueError):
        scalar.positive(0, 1, "limit")


def json_text(rng, depth=0):
    blank = rng.choice(["", "", " ", "\n\t"])
    if depth > 5 or rng.random() < 0.5:
        return rng.choice(["0", "-1.5e3", "01", "1.", "true", "nul", '"é中"', '"\\u00e9"', '"\\x"', '"😀aaaaaaaa"', '"bad\tx"', '"\\ud83d"']) + blank
    if rng.random() < 0.5:
        return f"[{blank}" + f",{blank}".join(json_text(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return "{" + f",{blank}".join(rng.choice(['"k"', '"é"', '"\\u0041"']) + f"{blank}:{blank}" + json_text(rng, depth + 1) for _ in range(rng.randrange(4))) + "}" + blank


def test_plain_entries_are_those_of_the_tokens(monkeypatch):
    rng = random.Random(8)
    plain, complete, pages = json_keys._PLAIN, 0, 0
    for _ in range(4000):
        text = ("{" + ",".join(f'"k{i}" : ' + json_text(rng) for i in range(rng.randrange(6))) + "}").encode()
        if rng.random() < 0.2 and len(text) > 3:
            at = rng.randrange(len(text))
            text = text[:at] + bytes([rng.choice([0x80, 0xFF, 34, 44, 125])]) + text[at + 1 :]
        limits = {k: v for k, v in {"limit": rng.randrange(1, 4), "max_preview": rng.randrange(1, 9), "max_depth": rng.randrange(1, 7), "max_scan_bytes": rng.randrange(1, len(text) + 3), "max_output_bytes": 8192 + rng.randrange(1, 400)}.items() if rng.random() < 0.4}
        cursor = None
        while True:
            monkeypatch.setattr(json_keys, "_PLAIN", plain)
            page = json_keys.scan_keys(text, cursor=cursor, **limits)
            monkeypatch.setattr(json_keys, "_PLAIN", re.compile(rb"(?!)"))
            assert page == json_keys.scan_keys(text, cursor=cursor, **limits), (text, limits)
            pages, complete, cursor = pages + 1, complete + (page["validation"] == "complete"), page["next_cursor"]
            if not cursor:
                break
    assert pages > 4000 and complete > 500


def test_plain_entries_take_one_step(monkeypatch):
    steps, real = [], json_keys._Scan.blank
    monkeypatch.setattr(json_keys._Scan, "blank", lambda self: (steps.append(1), real(self))[1])
    text = "{" + ", ".join(f'"k{i}": [{i}, {{"x": "é"}}]' for i in range(500)) + "}"
    assert json_keys.scan_keys(text.encode(), limit=1000)["total_keys"] == 500
    assert len(steps) < 10
