"""Token counts against the library's own unigram model; URL verdicts against plain rules."""

import random
import re

from tokenizers import Tokenizer, models

from corvane.llm.token_counts import MARK, VOCABULARY, UnigramCounter, read_vocabulary, token_counts
from corvane.llm.url_filters import BLOCK_GLOBS, RULES, GlobMachine, split_url, url_verdicts


def by_library(pieces, unknown_id, bytewise=True):
    return Tokenizer(models.Unigram(pieces, unk_id=unknown_id, byte_fallback=bytewise))


def test_counts_equal_the_library():
    pieces, unknown = read_vocabulary(VOCABULARY)
    tokenizer, counter = by_library(pieces, unknown), UnigramCounter(pieces, unknown)
    rng = random.Random(3)
    texts = ["", " ", "  a  b ", "Hello wörld, 42!", "日本語 ça va\n\tok", "x" * 3000, "a▁b ▁▁c", "\U0001f600 ok \x00"]
    texts += ["".join(rng.choice("ab cdé .\n日e t") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    for text in texts:
        expected = len(tokenizer.encode(MARK + text.replace(" ", MARK), add_special_tokens=False).ids) if text else 0
        assert counter.count(text) == expected, text


def test_ties_and_unknown_runs():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("ab", -1.0), ("b", -1.0), ("▁", -1.0)]
    tokenizer, counter = by_library(pieces, 0, False), UnigramCounter(pieces, 0)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aab z y") for _ in range(rng.randint(1, 14)))
        assert counter.count(text) == len(tokenizer.encode(MARK + text.replace(" ", MARK)).ids), text


def test_token_table(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(df).collect(), key=str)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [2, 2]
    assert [(r.n_chars, r.n_tokens) for r in got if r.doc_id != 1] == [(0, 0), (0, 0)]
    assert token_counts(df.limit(0)).count() == 0


def plain(url):
    host, path = split_url(url)
    best = None
    for verdict, rule in RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]

    def glob(g):
        head, _, tail = g.partition("/")
        return "[^/]*".join(map(re.escape, head.split("*"))) + "/" + ".*".join(map(re.escape, tail.split("*")))

    spam = any(re.fullmatch(glob(g), host + path, re.S) for g in BLOCK_GLOBS)
    return host, path, None, "block" if spam or not host else "allow"


def test_url_verdicts(spark):
    urls = [
        None, "", "nourl", "http://", "http://org/", "http://org", "http://a.ORG/x?y#z", "https://x.example.org/es/1", "https://example.org/en/12/", "http://notexample.org/es/",
        "http://a.com/x.org/y", "http://com/fr/", "http://b.com/de/?q", "http://b.com/DE/", "http://cheap-pills.net/x", "http://a.net/b/wp-login.php", "http://a.net/x.exe", "ftp://é.com/fr/ü", "http://a.com?x=/fr/", "x://y://z.org/",
    ]
    rng = random.Random(1)
    urls += ["http://" + "".join(rng.choice(["a", ".", "org", "com", "/", "fr", "example", "?", "de", "en/1", "casino"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_verdicts(df.limit(0)).count() == 0


def test_machine_wider_than_a_word():
    patterns = ["*abc*", "x" * 70 + "*", "a*b/*c", "*"]
    got = GlobMachine(patterns).matches([b"zzabczz", b"x" * 75, b"a--b/--c", b"", b"x" * 69])
    assert got.tolist() == [[True, False, False, True], [False, True, False, True], [False, False, True, False], [False, False, False, True], [False, False, False, True]]


def test_scores_that_are_not_whole_are_not_split():
    """Sums over words may round otherwise than sums over the text: no split then."""
    pieces = [("<unk>", 0.0), ("\u2581", -1.1), ("a", -0.7), ("b", -0.9), ("ab", -1.6), ("\u2581a", -1.8)]
    part, whole = UnigramCounter(pieces), UnigramCounter([(p, 10 * s) for p, s in pieces])
    assert not part.by_word
    assert UnigramCounter([(p, float(round(s))) for p, s in pieces]).by_word
    for text in ("ab a b ab", "a  b", "ba ab"):
        prepared = MARK + text.replace(" ", MARK)
        assert part.count(text) == part.best(prepared) and whole.count(text) == whole.best(prepared)
