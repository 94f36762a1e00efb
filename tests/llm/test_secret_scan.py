import hashlib
import random
import re
import string

from cohortal.core.settle import settle
from cohortal.llm import automata
from tests.llm.helpers import counted, empty_table, odd_rows, odd_table, prose

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{automata.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts(n=300):
    rng = random.Random(11)
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(k))
    out = []
    for k in range(n):
        secret = [f"password={hexed(18)}", f'token = "{hexed(40)}"', f"AKIA{upper(16)}", f"Api_Key: {hexed(24)}é", "token=abc secret:x", f"AKIA{upper(5)}", hexed(31)][k % 7]
        out.append(f"{prose(k, 20)} mail.{k}@example.com {secret} é\n{4000000000000000 + k} {prose(k + 1, 5)}")
    return out


def test_base_equals_brute_force(spark):
    data = list(enumerate(texts())) + [(None, "Token='abcdefgh'"), (1, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = automata.digest(automata.find_secrets(docs, settle)).collect()
    assert counted((r.doc_id, r.base_sha256) for r in out) == counted((k, hashlib.sha256(base(t).encode()).hexdigest()) for k, t in data)
    by_id = {r.doc_id: r for r in out if r.doc_id and r.doc_id > 1}
    for k, text in data[2:300]:
        own = base(text)
        assert (by_id[k].n_assign, by_id[k].n_access, by_id[k].n_hex) == tuple(own.count(f"{n}:") for n in automata.KINDS)
        assert set(filter(None, own.split(","))) <= set(by_id[k].spans.split(","))


def test_method_finds_the_format_without_its_label(spark):
    data = list(enumerate(texts()))
    bare = "9f86d081884c7d659a"  # the format of the passwords, without the word before it
    data += [(1000, f"see {bare} here"), (1001, "order 4293469861724982 for user-name-and-more-words"), (1002, "thequickbrownfoxjumps over")]
    out = {r.doc_id: r for r in automata.digest(automata.find_secrets(spark.createDataFrame(data, "doc_id long, text string"), settle)).collect()}
    assert out[1000].spans.split(":")[1:] == ["4", "22"] and out[1000].n_hex == out[1000].n_assign == 0
    assert out[1001].spans == out[1002].spans == ""


def test_automaton_merges_and_tells_formats_apart():
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(400)]
    tree = automata.Automaton({automata.classes_of(h): 1 for h in hexes})
    names = automata.Automaton({automata.classes_of(f"user-{rng.randrange(99)}-name-{w}"): 1 for w in prose(3, 300).split()})
    assert len(tree.red) < 30
    assert sum(n for n in tree.ends if n) >= 400
    for h in hexes[:50]:
        assert tree.score(automata.classes_of(h)) > names.score(automata.classes_of(h))
    # Shares out of a state add up to one with the smoothing of what was not seen.
    for state in tree.red:
        total = tree.visits[state]
        assert tree.ends[state] + sum(n for n, _ in tree.moves[state].values()) == total


def test_redaction(spark):
    data = list(enumerate(texts(40)))
    found = automata.find_secrets(spark.createDataFrame(data, "doc_id long, text string"), settle)
    for r in automata.redact(found).collect():
        assert base(r.text) == "" or "[SECRET]" in r.text
        assert r.text.count("[SECRET]") >= (base(data[r.doc_id][1]) != "")
        assert r.text.endswith(data[r.doc_id][1][-20:])


def test_odd_rows(spark):
    out = automata.digest(automata.find_secrets(odd_table(spark), settle)).collect()
    assert counted((r.doc_id, r.spans) for r in out) == counted((r[0], base(r[1])) for r in odd_rows())
    assert automata.redact(automata.find_secrets(odd_table(spark), settle)).columns == [c for c in odd_table(spark).columns if c != "secrets"]
    assert automata.find_secrets(empty_table(spark), settle).count() == 0
