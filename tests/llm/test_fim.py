import hashlib
import random

import pytest

from promptscreen.llm import fim
from promptscreen.llm.q_fim import op13_fim


def brute(doc_id, text, seed=1):
    """Form, prefix, middle and output, straight from the rule."""
    t = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16_384])
def test_frames_cut_and_restore_any_text(size):
    rng = random.Random(size)
    for _ in range(150):
        t = "".join(rng.choice("ab<PSM>é東🙂\0\n ") for _ in range(rng.randint(0, 40)))
        frames, ends = fim.frames_of(t, size)
        assert "".join(map(fim.unpack, frames)) == t and (ends[-1] if ends else 0) == len(t)
        a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        part = fim.section(frames, ends, a, b)
        assert "".join(map(fim.unpack, part)) == t[a:b]
        assert fim.digest(part) == hashlib.sha256(t[a:b].encode()).hexdigest()
        if any(m in t for m in ("<P>", "<S>", "<M>")):
            continue
        for form, out in (("psm", f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"), ("spm", f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"), ("plain", t)):
            assert "".join(map(fim.unpack, fim.restored(form, fim.frames_of(out, size)[0]))) == t


def test_uncut_frames_are_not_opened(monkeypatch):
    frames, ends = fim.frames_of("x" * 100_000, 1000)
    opened = []
    monkeypatch.setattr(fim, "unpack", lambda f, g=fim.unpack: opened.append(f) or g(f))
    part = fim.section(frames, ends, 1500, 98_200)
    assert len(opened) == 2 and part[1] is frames[2] and len(part) == 98


def test_output_without_its_markers_is_refused():
    for form, out in (("psm", "x<P>a<S>b<M>c"), ("psm", "<P>ab<M>c"), ("spm", "<P>a<S>b<M>c")):
        with pytest.raises(ValueError):
            fim.restored(form, [fim.pack(out)])


def test_table_against_the_rule(spark, awkward, no_docs):
    extra = [(801, "a <P> marker", "en", "s", 1), (802, "<S>", "en", "s", 1), (803, "<" * 50, "en", "s", 1), (804, "<P" * 20_000, "en", "s", 1)]
    df = awkward.unionByName(spark.createDataFrame(extra + [(900 + k, "é🙂" * k, "en", "s", 1) for k in range(60)], awkward.schema))
    rows = df.collect()
    framed = fim.framed(df, frame_chars=700)
    assert framed.columns == ["doc_id", "lang", "source", "n_chars", "framed"] and framed.count() == len(rows)
    filled = fim.infill(framed)
    found = fim.digests(fim.outputs(fim.infill(framed, into="again"), "again", "text").join(
        fim.originals(filled, into="back").select("doc_id", "back").distinct(), "doc_id", "left"), "again")
    want = {(r["doc_id"], r["text"]) for r in rows}
    texts = dict(want)
    forms = set()
    for r in found.collect():
        if r["doc_id"] is None:
            continue
        form, pre, mid, out = brute(r["doc_id"], texts[r["doc_id"]])
        forms.add(form)
        assert (r["again"]["form"], r["again"]["prefix_chars"], r["again"]["middle_chars"], r["text"], r["back"]) == (form, pre, mid, out, texts[r["doc_id"]] or "")
        assert r["digests"]["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["digests"]["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}
    assert fim.digests(fim.infill(fim.framed(no_docs))).count() == 0


def test_clashing_columns_keep_their_values(spark):
    df = spark.createDataFrame([(5, "some text to cut", "A", "B", "C", "D")], "doc_id long, text string, PLAN string, frames string, Form string, Framed string")
    got = fim.digests(fim.infill(fim.framed(df))).first()
    assert (got["PLAN"], got["frames"], got["Form"]) == ("A", "B", "C") and got["fim"]["form"] == brute(5, "some text to cut")[0]
    assert fim.framed(df).columns == ["doc_id", "PLAN", "frames", "Form", "framed"]


def test_query(spark, awkward, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op13_fim(spark, str(tmp_path)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in awkward.collect():
        form, pre, mid, out = brute(r["doc_id"], r["text"])
        want.append((r["doc_id"], len(r["text"] or ""), form, pre, mid, sha(out), sha(r["text"] or "")))
    assert got == sorted(want, key=str)
