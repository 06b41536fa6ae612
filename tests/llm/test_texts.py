import base64
import hashlib
import random
import re

import pytest

from thicket.llm.chat import HOSTILE, escape, format_chats, read_back, spans, tagged, unescape
from thicket.llm.license_scan import PHRASES, TEMPLATES, Index, blocks, scan_licenses, words
from thicket.llm.token_count import Automaton, count_tokens

PIECES = ["\\", "<turn", "</turn>", "#", "###", " ", "x", '"', "\n", "<", "/turn>", "é", "### Assistant:", "\U0001f600", ""]


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))
        assert unescape(escape(t)) == t


def test_spans_of_the_house_template():
    r = random.Random(2)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", 'a"b\\', ""]), "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 5))]
        out, found, rewrites = spans(turns)
        assert not rewrites and read_back(out, found) == turns
        assert [f[0] for f in found] == [0, *(f[3] for f in found)][: len(found)]


def test_a_template_that_rewrites_history_is_detected():
    def last_marked(turns):
        return "".join(("* " if k == len(turns) - 1 else "- ") + t + "\n" for k, (_, t) in enumerate(turns))

    assert spans([("user", "a"), ("assistant", "b")], last_marked)[2]
    assert not spans([("user", "a")], last_marked)[2]
    assert not spans([("user", "a"), ("assistant", "b")], lambda turns: "".join(t for _, t in turns))[2]


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(tagged(turns))


def test_format_chats(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (1, 2, None, "é", 9), (2, 5, "assistant", "b", 9), (2, None, "user", "first", 9), (2, 5, "assistant", "b", 9), (None, 0, "user", "x", 9), (-7, 0, "user", HOSTILE, 9), (-7, 1, "assistant", HOSTILE, 9)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in format_chats(convs).collect()}
    want = {1: [("user", "hi"), ("assistant", ""), ("", "é")], 2: [("user", "first"), ("assistant", "b"), ("assistant", "b")], None: [("user", "x")], -7: [("user", HOSTILE), ("assistant", HOSTILE)]}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == expected(turns)
        assert "".join(unescape(r["formatted"][a:b]) for a, b in r["loss_spans"]) == "".join(t for role, t in turns if role == "assistant")
    assert format_chats(convs.limit(0), texts=False).count() == 0


def greedy(word, vocabulary, mark, unknown=1):
    w, i, n = mark + word, 0, 0
    while i < len(w):
        j = next((j for j in range(len(w), i, -1) if w[i:j] in vocabulary), None)
        if j is None:
            return unknown
        i, n = j, n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    r = random.Random(3)
    for _ in range(200):
        vocabulary = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        vocabulary |= {b"a", b"b"} if r.random() < 0.7 else set()
        automaton = Automaton(vocabulary)
        for _ in range(40):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert automaton.length(w) == greedy(w, vocabulary, b"")


def test_count_tokens(spark):
    pieces = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"abc", b"c a", "é".encode()]
    texts = [None, "", "  \n", "ab abc", "abcabc é", "x" * 5000, "ab abc"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in count_tokens(docs, pieces).collect()}
    for i, t in enumerate(texts):
        counts = [greedy(w, set(pieces), b" ") for w in (t or "").encode().split()]
        assert tuple(got[i])[1:] == (len((t or "").encode()), len(counts), sum(counts), max(counts, default=0))
    assert len(got) == len(texts) + 1
    assert count_tokens(docs.limit(0), pieces).count() == 0


def test_words_are_the_pattern():
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice("aZ09_-\x00 \x7f\néÀ@[`{") for _ in range(r.randint(0, 20)))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        assert [w.decode() for w in words(t.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_blocks(text, least):
    found, out = words(text.encode()), []
    for label, template in TEMPLATES.items():
        t, width = set(words(template.encode())), len(words(template.encode()))
        for a, b in blocks(len(found), width):
            share = len(t & set(found[a:b])) / len(t)
            if share >= least - 1e-12:
                out.append((label, a, b, share))
    return sorted(out)


def test_scan_licenses(spark):
    r = random.Random(5)
    vocabulary = sorted({w.decode() for t in TEMPLATES.values() for w in words(t.encode())}) + ["foo", "bar", "licenses"]
    texts = [None, "", "MIT   license, mit\nLicense!", "the mit licenses", "Apache License; GNU General-Public License", "license", "general public license general public license"]
    texts += [" ".join(["foo"] * r.randint(0, 90) + [w for w in template.split() if r.random() < 0.85] + ["bar"] * r.randint(0, 90)) for template in TEMPLATES.values() for _ in range(4)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 300))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        found = [w.decode() for w in words((t or "").encode())]
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
        met, row = brute_blocks(t or "", 0.8), got[i]
        base = sorted({label for _, label in places})
        assert (row["n_words"], row["n_base"]) == (len(found), len(places))
        assert (row["first_word"], row["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert (row["base_labels"], row["labels"]) == (",".join(base), ",".join(sorted({*base, *(m[0] for m in met)})))
        assert row["score"] == pytest.approx(max((m[3] for m in met), default=float(bool(places))))
        assert [tuple(b) for b in row["blocks"]] == met
    assert scan_licenses(docs.limit(0)).count() == 0


def test_words_scattered_beyond_twice_a_template_do_not_meet_it(spark):
    text = "The band released a new record last year under the old name, although nobody had bought a license for the songs"
    docs = spark.createDataFrame([(1, text), (2, "Here: released under the MIT License.")], "doc_id long, text string")
    assert [r["labels"] for r in scan_licenses(docs).orderBy("doc_id").collect()] == ["", "mit,mit-notice"]


def test_index_loses_no_block_whatever_the_frequencies():
    r = random.Random(6)
    for _ in range(100):
        letters = "abcdefghij"
        templates = {f"t{k}": " ".join(r.sample(letters, r.randint(1, 8))) for k in range(4)}
        index = Index(templates, {c.encode(): r.randint(0, 5) for c in letters}, 0.7)
        block = frozenset(c.encode() for c in r.sample(letters, r.randint(0, 9)))
        want = {k: len({x.encode() for x in t.split()} & block) / len(t.split()) for k, t in templates.items()}
        assert index.scores(block) == {k: v for k, v in want.items() if v >= 0.7 - 1e-12}


def test_vocabulary_file_format(tmp_path):
    from thicket.llm.token_count import load_ranks

    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"ab") + b" 0\n" + base64.b64encode(b"\xff") + b" 1\n\n")
    assert load_ranks(str(path)) == [b"ab", b"\xff"]
