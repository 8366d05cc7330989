import csv
import io
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewright.sources import split_files as S
from ratewright.sources.charge_csv import ChargeCsv
from ratewright.sources.charge_csv import rows as csv_stream
from ratewright.sources.charge_json import ChargeJson, scan


def planned(data: bytes, chunk: int, path) -> list[dict]:
    """What the jobs of read_json work out, on the driver."""
    path.write_bytes(data)
    state, depth, chunks = 0, 0, []
    for at in range(0, len(data), chunk):
        size = min(chunk, len(data) - at)
        chunks.append({"events": S._json_events(str(path), at, size, state, depth)})
        leave = S._json_states(str(path), at, size)[state]
        state, depth = leave["to"], depth + leave["deeper"]
    return chunks


def outside(data: bytes) -> list[tuple[int, str]]:
    """Brackets and commas outside strings, one byte at a time."""
    out, string, escape = [], False, False
    for k, c in enumerate(data.decode("latin-1")):
        if string:
            string, escape = not (c == '"' and not escape), c == "\\" and not escape
        elif c == '"':
            string = True
        elif c in "{}[],":
            out.append((k, c))
    return out


VALUE = st.recursive(st.one_of(st.text(alphabet='ab"\\{[,:é😀', max_size=6), st.integers(), st.none()), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(alphabet='k"\\', max_size=3), x, max_size=3)), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=3), VALUE, max_size=3), max_size=5), VALUE, st.integers(1, 30), st.booleans())
def test_any_cut_finds_the_same_elements(tmp_path_factory, items, other, chunk, ascii_):
    data = json.dumps({"v": other, "standard_charge_information": items, "w": [1, [2]], "modifier_information": items[:1]}, ensure_ascii=ascii_).encode()
    path = tmp_path_factory.mktemp("x") / "f.json"
    state, depth, found = 0, 0, []
    path.write_bytes(data)
    for at in range(0, len(data), chunk):
        piece = np.frombuffer(data[at : at + chunk], np.uint8)
        m = S.Marks(piece, state == 2)
        found += [(at + int(k), chr(piece[k])) for k in m.at[m.inside == (state > 0)]]
        leave = S._json_states(str(path), at, len(piece))[state]
        state, depth = leave["to"], depth + leave["deeper"]
    assert found == outside(data) and (state, depth) == (0, 0)
    ranges, closed = S._json_ranges(planned(data, chunk, path), S.ARRAYS)
    assert [c["name"] for c in closed] == ["standard_charge_information", "modifier_information"]
    assert [json.loads(b"[" + data[c["open"] + 1 : c["close"]] + b"]") for c in closed] == [items, items[:1]]
    assert all(len(json.loads(b"[" + data[r["start"] : r["end"]] + b"]")) == (r["n"] if items else 0) for r in ranges)


BROKEN = [
    b'{"standard_charge_information": [{}, {"a": 1} {"b": 2}, {}]}', b'{"standard_charge_information": [{},{},]}', b'{"standard_charge_information": [{"a": "x', b'{"standard_charge_information": [{}], "standard_charge_information": [{"z": 1}]}',
    b'{"standard_charge_information": [tru"e, {"a": "b, c"}, {}], "v": 1}', b'{"v": tru"e, "standard_charge_information": [{}, {}]}', b'{"standard_charge_information": [{}, {}]} x', b'{"standard_charge_information": [{"a": [}, {"b": 1}]}', b'[{"standard_charge_information": [1, 2, 3, 4, 5, 6]}]', b'{"standard_charge_information": {"a": [1, 2]}}', b'{"a": \\"x", "standard_charge_information": [{}, 5]}',
]


def documents():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice('ab "\\{}[],:é日😀\n') for _ in range(rng.randint(0, 12)))
    item = lambda: {"description": text(), "codes": [{"code": text(), "n": rng.random()} for _ in range(rng.randint(0, 3))], text(): None}
    whole = {"hospital_name": text(), "attestation": {"a": [1, 2], "b": ","}, "standard_charge_information": [item() for _ in range(60)], "z": [[1], [2, 3]], "modifier_information": [item() for _ in range(9)], "end": "}"}
    odd = json.dumps(whole, ensure_ascii=False).encode().replace(b'{"description"', b'42, "x", {"d": 1, "d": 2}, {"y": "\xff\xfe"}, {bad}, {"description"', 3)
    spaced = json.dumps(whole, indent=3).encode()
    return [json.dumps(whole).encode(), odd, b"\xef\xbb\xbf" + odd, spaced, json.dumps({"standard_charge_information": [], "modifier_information": []}, indent=1).encode(), json.dumps({"a": 1}).encode(), *BROKEN]


@pytest.mark.parametrize("chunk", [13, 300])
def test_json_rows_are_the_streams(spark, tmp_path, chunk):
    docs = documents()
    for k, d in enumerate(docs):
        (tmp_path / f"f{k:02d}.json").write_bytes(d)
    spark.dataSource.register(ChargeJson)
    key = lambda r: str(tuple(r))
    want = sorted(spark.read.format("charge_json").load(str(tmp_path)).collect(), key=key)
    got = sorted(S.read_json(spark, str(tmp_path), chunk=chunk, large=20, most_tasks=8).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert sum(r.part == "source" for r in got) == len(docs) and sum(r.part == "standard_charge_information" for r in got) > 240


def test_whole_documents_are_split(spark, tmp_path):
    """Nothing falls back to a stream that needn't."""
    for k, d in enumerate(documents()[:6]):
        (tmp_path / f"f{k}.json").write_bytes(d)
    seen = []
    finish, S._finish = S._finish, lambda spark, source, files, rows, doubtful, small: seen.append(doubtful.count()) or finish(spark, source, files, rows, doubtful, small)
    try:
        S.read_json(spark, str(tmp_path), chunk=64, large=0, most_tasks=8)
    finally:
        S._finish = finish
    assert seen == [0]


def tables():
    rng = random.Random(8)
    cell = lambda: rng.choice(["", "plain", 'in "quotes"', "two\nlines", "a,b", "é日😀", "\r\n", "12.5"])
    out = io.StringIO()
    csv.writer(out).writerows([[cell() for _ in range(rng.randint(1, 5))] for _ in range(200)])
    text = out.getvalue()
    unix = text.replace("\r\n", "\n")
    return [text.encode(), b"\xef\xbb\xbf" + unix.encode(), text.replace("日", "ü").replace("😀", "ß").encode("latin-1"), b"\xef\xbb\xbf" + unix.replace("日", "").replace("😀", "").encode("latin-1"), b'5" pipe,x\nnext,"row\nof it"\n7" pipe,y\n' * 30, b'"never closed\n' + b"a,b\n" * 50, b"\n\n\n" + b"a\n" * 40, b"a,b\r" * 60, "é".encode() * 200, b"x,y\n" * 30 + b"\xe9", b"p,q\n" * 20 + b'"open']


@pytest.mark.parametrize("chunk", [7, 150])
def test_csv_rows_are_the_streams(spark, tmp_path, chunk):
    for k, d in enumerate(tables()):
        (tmp_path / f"f{k:02d}.csv").write_bytes(d)
    spark.dataSource.register(ChargeCsv)
    key = lambda r: (r.file, r.row_index)
    want = sorted(spark.read.format("charge_csv").load(str(tmp_path)).collect(), key=key)
    got = sorted(S.read_csv(spark, str(tmp_path), chunk=chunk, large=10, most_tasks=8).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert {r.encoding for r in got} == {"utf-8-sig", "latin-1"}


def test_utf8_is_settled_by_chunks(tmp_path):
    path = tmp_path / "t"
    for text in (b"ab\xc3\xa9\xe6\x97\xa5\xf0\x9f\x98\x80z", b"\xc3", b"\xa9\xa9", b"a\xe6\x97", b"\xf0\x9f\x98\x80" * 5, b"\xc3\xa9\xa9", b"\xe6\x97\xa5\xc3\xc3\xa9"):
        path.write_bytes(text)
        try:
            text.decode()
            want = True
        except UnicodeDecodeError:
            want = False
        for chunk in range(1, len(text) + 1):
            parts = [S._csv_facts({"file": str(path), "size": len(text), "k": at // chunk, "start": at, "length": min(chunk, len(text) - at)}) for at in range(0, len(text), chunk)]
            assert all(p["utf8"] for p in parts) == want, (text, chunk)


def test_an_empty_table_beside_large_ones(spark, tmp_path):
    """A task without rows leaves an empty file, the only one that isn't split."""
    for k, d in enumerate([b"", b"a,b\n" * 50]):
        (tmp_path / f"f{k}.csv").write_bytes(d)
    got = S.read_csv(spark, str(tmp_path), chunk=16, large=20, most_tasks=8)
    assert sorted((r.file[-6:], r.row_index) for r in got.where("row_index <= 0").collect()) == [("f0.csv", -1), ("f1.csv", -1), ("f1.csv", 0)]
    assert got.count() == 52


def test_an_empty_document_beside_large_ones(spark, tmp_path):
    for k, d in enumerate([b"", json.dumps({"standard_charge_information": [{"a": 1}] * 9}).encode()]):
        (tmp_path / f"f{k}.json").write_bytes(d)
    got = S.read_json(spark, str(tmp_path), chunk=16, large=20, most_tasks=8)
    assert got.where("part = 'standard_charge_information'").count() == 9
    assert [r.problem for r in got.where("part = 'stream'").collect()] == ["expected '{' at the start"]
