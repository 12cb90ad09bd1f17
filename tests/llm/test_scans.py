import ast
import hashlib
import math
import random
import re
import time

from parchment.llm import decontamination as dc
from parchment.llm import licenses, secrets

from .conftest import make

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark, odd, odd_rows, empty):
    rng = random.Random(2)
    vocabulary = "mit license apache general public MIT License, GPL the of licensed under version 2.0 é".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(150)]
    for r in licenses.scan_licenses(make(spark, rows)).collect():
        text = rows[r.doc_id][1]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_license(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(odd).count() == len(odd_rows) and licenses.scan_licenses(empty).count() == 0


def test_license_template_without_a_base_phrase():
    scanner = licenses.Scanner()
    label, template = licenses.TEMPLATES[0]
    words = template.split()
    words[20] = "hereunder"  # chains bridge a changed word
    n, base, *_, labels, score, spans = scanner.scan("some words before " + " ".join(words) + " after")
    assert base == 0 and labels == label and score == 1.0 and spans.startswith("mit:3:")
    assert scanner.scan("permission is hereby not granted to publish or sell the sea")[5] == ""


def test_whole_licences_are_one_span():
    scanner = licenses.Scanner()
    for k, (label, template) in enumerate(licenses.TEMPLATES):
        words = [w.decode() for w in licenses.words_nonempty(template)]
        if len(words) < 60:
            continue
        for broken in ((), (len(words) // 3, 2 * len(words) // 3)):  # words changed here and there
            text = ["intro"] * 5 + [w if i not in broken else "changed" for i, w in enumerate(words)] + ["outro"] * 4
            said = [x.split(":") for x in scanner.scan(" ".join(text))[7].split(",")]
            assert [label, "5", str(5 + len(words))] in said, (label, broken, said)
            assert max(int(e) - int(a) for la, a, e in said if la != label) < 40 if any(la != label for la, *_ in said) else True


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(4)
    strings = [[rng.choice((b"a", b"b", b"c")) for _ in range(rng.randint(1, 14))] for _ in range(5)]
    sam = licenses.Automaton(strings)
    every = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(2000):
        q = tuple(rng.choice((b"a", b"b", b"c")) for _ in range(rng.randint(1, 7)))
        v = 0
        for w in q:
            v = sam.next[v].get(sam.number.get(w)) if v is not None else None
        assert (v is not None) == (q in every)
        if v:
            for k, end in sam.ends[v].items():
                assert tuple(strings[k][end - len(q) + 1 : end + 1]) == q


def plain_secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_base_against_brute_force(spark, odd, odd_rows, empty):
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdefgh12", "x", "AKIA", "AKIAABCDEFGHIJKL12", "deadbeef" * 4, "deadbeef", "é", "\n", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), "en", "s") for i in range(400)]
    for r in secrets.scan_secrets(make(spark, rows)).collect():
        want = plain_secrets(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secrets.KINDS[:3])
    assert secrets.scan_secrets(odd).count() == len(odd_rows) and secrets.scan_secrets(empty).count() == 0


def test_secret_pairs_follow_constants():
    say = lambda t: [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in secrets.listed(secrets.scan_text(t)[1]).split(",") if s) if k == "pair"]
    assert say('DB_PASS = "hunter2Xy9"\nconn = f(x)\nadmin_password = DB_PASS') == ["hunter2Xy9"]
    assert say('k = "abc1" + "DEF23x"\nauthToken = k') == ["abc1", "DEF23x"]
    assert say('{"aws_secret_access_key": "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"}') == ["wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"]
    assert say("password = os.environ['X']\nsecret: changeme\nthe token: a sign of things to come; key = value") == []
    assert secrets.redact('token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" end') == 'token = "[REDACTED]" end'
    assert secrets.redact(None) is None and secrets.redact("plain words") == "plain words"


def test_secret_pairs_of_any_length():
    say = lambda t: [t[a:b] for a, b, kind, *_ in secrets.scan_text(t)[1] if kind == 3]
    rng = random.Random(5)
    key = "".join(rng.choice("ABCxyz012345/+") for _ in range(600))
    assert say(f"<token>{key}</token>") == [key] and secrets.redact(f"<token>{key}</token>") == "<token>[REDACTED]</token>"
    name = "a" * 300 + "_pwd"
    assert say(f"<{name}>{key}</{name}>") == [key]
    assert say(f'{name} = "hunter2Xy9"') == ["hunter2Xy9"] and say(f'x["{"db " * 100}pwd"] = "hunter2Xy9"') == ["hunter2Xy9"]
    assert say(f'{name}{" " * 400}= "hunter2Xy9"') == ["hunter2Xy9"]
    assert say(f'{"pwd" + "_x" * 200} = "hunter2Xy9"') == ["hunter2Xy9"]
    assert say('k = "aB3" + "9xQ" + "7Zt" + ""\nauthToken = k') == ["aB3", "9xQ", "7Zt"]
    assert secrets.redact('pwd = "aB3" + "9xQ" + "7Zt"') == 'pwd = "[REDACTED]" + "[REDACTED]" + "[REDACTED]"'


def plain_pairs(source):
    """Places of accepted pairs, by the compiler's own tree of the source, with values written out."""
    held, found = {}, set()
    starts = [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)

    def value(node):
        if isinstance(node, ast.Constant):
            a = starts[node.lineno - 1] + node.col_offset + 1
            return [(a, a + len(node.value))]
        if isinstance(node, ast.Name):
            return held.get(node.id)
        left, right = value(node.left), value(node.right)
        return None if left is None or right is None else left + right

    def judge(name, places, quoted=1):
        whole = "".join(source[a:b] for a, b in places)
        classes = sum(bool(re.search(p, whole)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        entropy = -sum(whole.count(c) / len(whole) * math.log2(whole.count(c) / len(whole)) for c in set(whole))
        random_ = 0 if len(whole) < 6 or " " in whole else min(1, (classes - 1) / 2 * 0.6 + min(entropy, 4) / 4 * 0.4)
        if secrets.sensitivity(name) >= 0.7 and 0.6 * secrets.sensitivity(name) + 0.3 * random_ + 0.1 * quoted >= secrets.ACCEPT:
            found.update(places)

    for statement in ast.parse(source).body:
        if isinstance(statement, ast.Expr):  # a setting call
            for places in filter(None, map(value, statement.value.args)):
                judge(statement.value.func.attr, places)
            continue
        name, node = statement.targets[0].id, statement.value
        if isinstance(node, ast.Dict):
            for k, v in zip(node.keys, node.values):
                if (places := value(v)) is not None:
                    judge(k.value, places)
        elif isinstance(node, ast.List):
            for places in filter(None, map(value, node.elts)):
                judge(name, places)
            held.pop(name, None)
        elif (places := value(node)) is not None:
            held[name] = places
            judge(name, places)
    return sorted(found)


def test_secret_pairs_against_the_compiler():
    rng = random.Random(8)
    names = ["a", "b", "db_pwd", "myCredentials", "signing_key", "colour", "bearerValue", "pass_"]
    literal = lambda: '"' + "".join(rng.choice(rng.choice(["abcxyz", "ABC", "0123", "ab 1", "_-"])) for _ in range(rng.randint(1, 12))) + '"'
    hits = 0
    for _ in range(400):
        known, lines = [], []

        def total():
            terms = [rng.choice(known) if known and rng.random() < 0.4 else literal() for _ in range(rng.randint(1, 3))]
            return "(" + rng.choice([" + ", " +\n    "]).join(terms) + ")" if rng.random() < 0.3 else " + ".join(terms)

        for _ in range(rng.randint(1, 8)):
            name, kind = rng.choice(names), rng.random()
            if kind < 0.6:
                lines.append(f"{name} = {total()}")
                known.append(name)
            elif kind < 0.75:
                lines.append(f"{name} = [{', '.join(total() for _ in range(rng.randint(1, 3)))}]")
                known = [k for k in known if k != name]
            elif kind < 0.9:
                lines.append("conf = {" + ", ".join(f'"{rng.choice(names)}": {literal()}' for _ in range(rng.randint(1, 3))) + "}")
            else:
                lines.append(f"client.set_{rng.choice(names)}({total()})")
        source = "\n".join(lines)
        base, every = secrets.scan_text(source)
        want = [(a, b) for a, b in plain_pairs(source) if not any(s[0] <= a and b <= s[1] for s in base)]
        assert [(a, b) for a, b, k, *_ in every if k == 3] == want, source
        hits += len(want)
    assert hits > 300


def test_secret_syntax():
    say = lambda t: [t[a:b] for a, b, k, *_ in secrets.scan_text(t)[1] if k == 3]
    key = "hunter2Xy9"
    for t in (
        f'"credentials": ["{key}"]', f'pwd = "{key[:5]}" \\\n  "{key[5:]}"', f'obj.setCredential("{key}")', f'put("db_pwd", "{key}")', f'login(user, pwd="{key}")', f'pwd: str = "{key}"',
        f'<add key="dbPwd" value="{key}"/>', f"- name: DB_PWD\n  value: {key}\n", f"pwd:\n  '{key}'", f'pwd = """{key}"""', f"?user=b&pwd={key}&x=1", f"PWD={key}\nmy_credential=$PWD", f"don't pwd='{key}' it's",
    ):
        assert "".join(say(t)) == key, t
    for t in (f'get_credential("{key}")', f'pwd:\n  "user": "{key}"', f'pwd == "{key}"', f"pwd = load('{key}')", 'pwd = """' + key):
        assert say(t) == [], t


def test_secrets_take_linear_time():
    began = time.perf_counter()
    say = lambda t: sum(s[2] == 3 for s in secrets.scan_text(t)[1])
    assert say('a = "xX1y2z"\n' + "a = a + a\n" * 5000 + "pwd = a\n" * 100) == 1
    assert say('a = "xX1y2z"\n' + 'a = a + "q"\n' * 20_000 + "pwd = a\n" * 1000) == 20_001
    for t in ("a=" * 10**6, '\\"' * 10**5, "'\"`" * 10**5, "(" * 10**6, "=[" * 10**5, ":   " * 10**5, "pwd" + " " * 10**6 + "=", "pwd =\n" * 10**5, '"""' * 100_001):
        assert say("pwd " + t) == 0
    assert time.perf_counter() - began < 60


def plain_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        before = row[0]
        for i in range(1, len(p) + 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (p[i - 1] != c))
        best = min(best, row[-1])
    return best


def test_myers_against_dynamic_programming():
    rng = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(a, b))) for a, b in ((1, 90), (0, 120)))
        assert dc.myers(p, t)[0] == plain_distance(p, t)


def test_benchmark_hits_against_brute_force(spark, odd, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30)))) for i in range(8)]
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        if i % 2:
            item = list(items[i % 8][1].upper() if i % 3 else items[i % 8][1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "\n"])
            text += " " + "".join(item) + " " + " ".join(word() for _ in range(10))
        rows.append((i, text, "en", "s"))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    want = set()
    for i, t, *_ in rows:
        for n, p in items:
            d = plain_distance(dc.normal(p), dc.normal(t))
            if d <= dc.budget(dc.normal(p)):
                want.add((i, n, d))
    docs = make(spark, rows)
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.benchmark_hits(docs, bench).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and got == want and len(want) > 8
    left = {r.doc_id for r in dc.without_benchmark(docs, bench).collect()}
    assert left == {i for i, *_ in rows} - {w[0] for w in want}
    assert dc.benchmark_hits(odd, bench).count() == 0 and dc.benchmark_hits(empty, bench).count() == 0
    assert dc.benchmark_hits(docs, bench.limit(0)).count() == 0 and dc.without_benchmark(odd, bench.limit(0)).columns == odd.columns


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 30)
    bench = spark.createDataFrame([(i, f"item number {i} of the benchmark set") for i in range(5)], "item_id long, text string")
    docs = make(spark, [(7, "x item number 3 of the benchmark set, item number 1 of the benchmark set", "en", "s")])
    assert {r.item_id for r in dc.benchmark_hits(docs, bench).where("distance = 0").collect()} == {1, 3}
