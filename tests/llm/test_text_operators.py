"""Operators that treat each text by itself: BPE, fingerprints, packing, licences, decontamination."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from cases import CLASHES, ODD_ROWS, frame, prose, tuples
from tripflow.llm import bpe, common, decontaminate, fingerprint, licences, packing

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeTable.load(JSON_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON_VOCABULARY)


def ids_of(merges, text):
    return np.frombuffer(bpe.encode(bpe.PieceTable(merges), text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" '\n\taes0"))), max_size=80))
def test_bpe_equals_library(text):
    table = test_bpe_equals_library.table
    got = np.frombuffer(bpe.encode(table, text), "<u4").tolist()
    assert got == test_bpe_equals_library.library.encode(text, add_special_tokens=False).ids
    assert "".join(bpe.decode(table.merges, np.array(got, "<u4").tobytes())) == text


test_bpe_equals_library.table = bpe.PieceTable(bpe.MergeTable.load(JSON_VOCABULARY))
test_bpe_equals_library.library = Tokenizer.from_file(JSON_VOCABULARY)


def test_bpe_long_pieces_and_portions(merges, library, monkeypatch):
    r = random.Random(5)
    texts = ["a" * 70_000, " " * 9_000 + "x", "-" * 5_000 + "' 're", "a<|endoftext|> b<|endoftext|>", "it's we'll 'rex"]
    texts += ["".join(r.choice("abdeé 'srl01\n.-語😀") * r.choice([1, 1, 2, 5, 90, 400]) for _ in range(20)) for _ in range(150)]
    monkeypatch.setattr(bpe, "PORTION", 64)
    for t in texts:
        assert ids_of(merges, t) == library.encode(t, add_special_tokens=False).ids


def test_lookahead_is_sufficient_for_any_merge_list():
    """Streams of random merge lists give what merging the whole text gives, whatever the portions."""
    r = random.Random(11)
    for _ in range(120):
        tokens = {bytes([b]): b for b in range(256)}
        merges = []
        for k in range(r.randint(1, 25)):
            a, b = (r.choice([t for t in tokens if set(t) <= set(b"abc")]) for _ in range(2))
            if len(a + b) <= 9 and a + b not in tokens:
                tokens[a + b] = 256 + k
                merges.append((a, b))
        table = bpe.MergeTable(tokens, merges)
        data = bytes(r.choices(b"abc", k=700))
        stream, out = bpe.PieceStream(table), []
        stream.window = table.lookahead + r.randint(1, 12)
        for at in range(0, len(data), 7):
            out += stream.feed(data[at:at + 7])
        assert out + stream.finish() == table.merge(data) == table._merge_long(list(data))


def test_decoder_joins_characters_over_portions(merges):
    ids = ids_of(merges, "語😀é")
    machine = bpe.ByteDecoder(merges)
    assert "".join(machine.feed([i], k == len(ids) - 1) for k, i in enumerate(ids)) == "語😀é"
    assert bpe.ByteDecoder(merges).feed([ids[0]], True) == "�"


def test_bpe_operator(spark, library):
    common.prepare(spark)
    got = tuples(bpe.bpe_roundtrip(frame(spark, ODD_ROWS, True), JSON_VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in ODD_ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.bpe_roundtrip(frame(spark, []), JSON_VOCABULARY, keep_ids=True).count() == 0


# --- fingerprints


def test_fingerprint_is_a_multiset_homomorphism():
    F = fingerprint.Fingerprint
    a, b = "first paragraph here", "second paragraph, longer than the first"
    assert F.of(f"{a}\n{b}") == F.of(f"{b}\n\n{a}") == F.of(a) + F.of(b)
    assert F.of(f"{a}\n{b}\n{a}") - F.of(a) == F.of(f"{a}\n{b}")
    assert F.of(f"{a}\n{a}") != F.of(a) and F.of(None) == F.of("") == F()
    assert F.parse(F.of(a).text()) == F.of(a)


def test_likeness_follows_what_is_shared():
    F, base = fingerprint.Fingerprint, prose(1, 900)
    for share in (0.2, 0.5, 0.8):
        k = int(len(base) * share)
        other = base[:k] + prose(2, 900)[:len(base) - k]
        assert abs(F.of(base).likeness(F.of(other)) - share) < 0.15
    assert F.of(base).likeness(F.of(prose(3, 900))) < 0.2 and F().likeness(F()) == 1 and F().likeness(F.of(base)) == 0


def edited_rows(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    F = fingerprint.Fingerprint
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        yield (i, len(t), hashlib.sha256(new.encode()).hexdigest(), F.of(t).text(), F.of(new).text(),
               F.of(t).likeness(F.of(new)), F.of(t).likeness(F.of(following)))


@pytest.mark.parametrize("rows", [ODD_ROWS, [(4, "alone with enough characters")], [(i % 40, prose(i, 30)) for i in range(200)], []])
def test_fingerprint_operator(spark, rows):
    common.prepare(spark)
    got = fingerprint.fingerprints(frame(spark, rows, True))
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert tuples(got, *cols) == sorted(edited_rows(rows), key=str)


# --- packing


def test_best_fit_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        length = r.choice([1, 2, 7, 8, 9, 100])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 120))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(length - s)
        rows = packing.best_fit(sizes, length)
        assert sorted(sum(rows, [])) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(rooms)


@pytest.mark.parametrize("length,block", [(16, 64), (2048, 1 << 21)])
def test_packing_is_lossless(spark, length, block):
    common.prepare(spark)
    rows = ODD_ROWS + [(100 + i, prose(i, 40)) for i in range(30)]
    packed = packing.pack_tokens(frame(spark, rows, True), RANK_VOCABULARY, length, block_tokens=block).collect()
    encoding = packing.load_encoding(RANK_VOCABULARY)
    parts = {}
    for p in packed:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == length and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens
        assert (ids[p.n_tokens:] == 50256).all()
        assert p.position_resets == (p.cu_seqlens if p.n_tokens < length else p.cu_seqlens[:-1])
        assert np.flatnonzero(packing.positions(p.cu_seqlens, length) == 0).tolist() == p.position_resets
        for d, first, a, b in zip(p.doc_ids, p.first_tokens, p.cu_seqlens, p.cu_seqlens[1:]):
            parts.setdefault(d, Counter())[first, tuple(ids[a:b].tolist())] += 1
    want = {}
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        for at in range(0, len(ids), length):
            want.setdefault(i, Counter())[at, tuple(ids[at:at + length])] += 1
    assert parts == want and len({(p.block, p.row_no) for p in packed}) == len(packed)
    assert isinstance(encoding, tiktoken.Encoding)


def test_packing_empty(spark):
    assert packing.pack_tokens(frame(spark, []), RANK_VOCABULARY).count() == 0


# --- licences


def test_licences(spark, duck):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and "charge" in t)
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,").replace("\n", "  \n").replace("SUBLICENSE", "SUBLICENCE")
    rows = ODD_ROWS + [(20, mit), (21, changed), (22, mit + "\nAnd more."), (23, "Some prose.\nreleased under the MIT licence\nEnd."),
                       (24, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licences.scan_licences(frame(spark, rows, True)).collect() if r.doc_id and r.doc_id != 6}
    assert got[20].licence == got[21].licence == "MIT" and got[20].digest == got[21].digest
    assert got[22].licence is None and got[23].notices == "MIT" and got[23].n_notice_lines == 1
    assert (got[24].notices, got[24].n_notice_lines) == ("CC-BY-NC-4.0,MIT", 3)
    assert got[1].digest is None and got[1].notices == "" and got[1].n_notice_lines == 0
    assert licences.scan_licences(frame(spark, rows)).count() == len(rows)
    assert licences.scan_licences(frame(spark, [])).count() == 0
    own = spark.createDataFrame([("House", "our own terms"), (None, None)], "licence string, text string")
    assert [r.licence for r in licences.scan_licences(frame(spark, [(1, "Our OWN terms!")]), own).collect()] == ["House"]


def test_standard_licence_files(spark):
    """Whole files with titles, statements of copyright and other line breaks."""
    def wrapped(text, width):
        parts = re.split(r"\n[ \t]*\n", text)
        return "\n\n".join(x if re.search(r"(?im)^\W*copyright (\(c\)|\[yyyy)", x) else textwrap.fill(
            " ".join(x.split()), width, break_long_words=False) for x in parts)

    rows, want = [], {}
    texts = [(n, t) for n, t in licences.KNOWN if "\n" in t] + licences.file_texts()
    assert len(texts) == 22 and all(t.strip() for _, t in texts)
    assert all(re.search("warrant|lesser", t.lower()) for _, t in licences.file_variants())
    for name, text in texts:
        title = licences.TITLES.get(name, ("",))[0]
        heads = ["", f"{title}\n\nCopyright (c) 2019-2021, The Authors of X\nAll rights reserved.\n\n", f"{title}\n© 2020 X\n(c) 2021 Y\n"]
        for head, width in [(heads[0], 0), *((heads[1], w) for w in (0, 30, 47, 60, 72, 79, 200)), (heads[2], 66)]:
            rows.append((len(rows), head + (wrapped(text, width) if width else text)))
            want[len(rows) - 1] = name
    own = [
        ("ISC", "ISC License\n\nCopyright (c) 2020, Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any\n"
         "purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all "
         "copies.\n\n" + licences._ISC_WARRANTY),
        ("BSD-3-Clause", "Copyright (c) 2020, Somebody\n\n" + dict(licences.KNOWN)["BSD-3-Clause"].replace(
            "the copyright holder nor", "Some Body Inc. nor").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR").replace("1. ", "* ")
         .replace("2. ", "* ").replace("3. ", "* ")),
        ("Apache-2.0", dict(licences.file_texts())["Apache-2.0"].split("APPENDIX")[0]),
        ("GPL-2.0", dict(licences.file_texts())["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
                                                                  "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
        (None, dict(licences.file_texts())["GPL-3.0"] + "\nAnd more."), (None, "copyright notice\nwithout warranty"),
        (None, dict(licences.KNOWN)["MIT"].replace("Software", "Software", 1) + "\nwithout warranty")]
    for name, text in own:
        rows.append((len(rows), text))
        want[len(rows) - 1] = name
    got = {r.doc_id: r.licence for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert {k: (got[k], want[k], rows[k][1][:60]) for k in want if got[k] != want[k]} == {}
    house = spark.createDataFrame([("House", "Our terms.\nThe\ncopyright notice stays.")], "licence string, text string")
    assert [r.licence for r in licences.scan_licences(frame(spark, [(1, "our terms. the copyright\nnotice stays")]), house).collect()] == ["House"]


# --- decontamination


def brute_leaks(rows, items):
    def shingled(w):
        return [tuple(w[j:j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    out = []
    for i, t in rows:
        w = decontaminate.words_of(t)
        for item, text in items:
            v = decontaminate.words_of(text)
            if not v or not w or (len(v) < 5 and len(w) < len(v)):
                continue
            c, m = Counter(shingled(v)), min(len(v), len(w))
            best = max(decontaminate.similarity(Counter(shingled(w[a:a + m])), c) for a in range(len(w) - m + 1))
            if best >= 0.8:
                out.append((i, item, round(best, 9)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    common.prepare(spark)
    r = random.Random(9)
    items = [(k, prose(100 + k, r.randint(14, 60)).capitalize() + ".") for k in range(12)] + [
        (50, "tiny item"), (51, None), (52, ""), (53, "three small words"), (54, "again " * 20)]
    rows = list(ODD_ROWS)
    for k in range(60):
        words = items[k % 12][1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(["changed", "x"])
        body = [prose(200 + k, 20), " ".join(words).upper() + "!!", prose(300 + k, 20)]
        rows.append((1000 + k, " ".join(body[r.randint(0, 1):r.randint(2, 3)])))
    rows += [(2000, "a tiny item here"), (2001, "Tiny, item"), (2002, "again " * 17), (2003, "again " * 300), (2004, "three small WORDS")]
    rows += [(3000 + k, prose(500 + k, 50)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id, round(x.similarity, 9)) for x in decontaminate.find_leaks(frame(spark, rows, True), bench).collect()),
                 key=str)
    want = brute_leaks(rows, items)
    assert got == want and len(want) > 30
    kept = decontaminate.drop_leaks(frame(spark, rows, True), bench)
    assert set(CLASHES) < set(kept.columns)
    assert tuples(kept, "doc_id") == sorted(((i,) for i, _ in rows if i not in {w[0] for w in want}), key=str)
    assert decontaminate.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
