import re

from ragloom.llm import secrets as X

KEY = "AKIA" + "ABCD1234EFGH5678"


def brute(rows, scope):
    """Pairs and endpoints by comparing all parts of a text with each other."""
    found = set()
    gap = lambda a, b: max(a[2] - b[3], b[2] - a[3], 0)
    for doc_id, text in {r for r in rows if None not in r}:
        parts = [(X.PARTS[m.lastindex - 1][0], X.PARTS[m.lastindex - 1][1], m.start(), m.end(), m[0]) for m in re.finditer(X.PATTERN, text, re.A)]
        for p in [p for p in parts if p[0] == "endpoint" and "@" in p[4].split("//")[-1].split("/")[0]]:
            scheme, rest = p[4].split("//", 1)
            if ":" in rest.split("@")[0]:
                name, word = rest.split("@")[0].split(":", 1)
                at = p[2] + len(scheme) + 2
                parts += [("identifier", "weak", at, at + len(name), name), ("secret", "weak", at + len(name) + 1, at + len(name) + 1 + len(word), word)]
        ids, secrets, ends = ([p for p in parts if p[0] == k] for k in ("identifier", "secret", "endpoint"))
        pairs = [(i, s) for i in ids for s in secrets if gap(i, s) <= scope]
        pairs += [(i, None) for i in ids if i[1] == "strong" and not any(i is a for a, _ in pairs)]
        pairs += [(None, s) for s in secrets if s[1] == "strong" and not any(s is b for _, b in pairs)]
        for i, s in pairs:
            near = sorted((gap(e, s or i), e[2], e) for e in ends if all(gap(e, p) <= scope for p in (i, s) if p))
            e = near[0][2] if near else None
            there = [p for p in (i, s, e) if p]
            found.add((doc_id, i and i[4], s and s[4], e and e[4], min(p[2] for p in there), max(p[3] for p in there), "strong" if "strong" in [p[1] for p in (i, s) if p] else "linked"))
    return found


def test_linking(docs_of):
    rows = [
        (1, f"key {KEY} with secret_key = abcdefgh12345678 at https://api.example.com/v1 done"),
        (2, "password=hunter2hunter2 and nothing else"),
        (3, "mail joe@example.com now password: correcthorse9"),
        (4, "mail joe@example.com " + "x" * 300 + " password: correcthorse9"),
        (5, f"only {KEY} here " + "y" * 250 + " http://far.example.com/"),
        (6, "no parts: at all"),
        (7, "user=root token = deadbeefdeadbeef 10.1.2.3:8080 and 10.9.9.9 " + "z " * 400 + "login: bob pwd=secretsecret"),
        (8, "-----BEGIN RSA PRIVATE KEY-----"),
        (8, "-----BEGIN RSA PRIVATE KEY-----"),
        (9, "db postgres://admin:hunter2!@db.example.com:5432/x and https://joe@example.com/ at ftp://a:b@c.de"),
        (10, f"user=root -----BEGIN PRIVATE KEY-----\n{'MIIEvQ+/9a' * 200}=\n-----END PRIVATE KEY----- host https://k.example.com/"),
        (11, f"far@example.com {'x' * 900} -----BEGIN EC PRIVATE KEY-----\n{'Ab1' * 300}\n-----END EC PRIVATE KEY----- {'y' * 150} {KEY}"),
    ]
    out = {tuple(r) for r in X.credentials(docs_of(rows)).collect()}
    assert out == brute(rows, X.SCOPE)
    assert {r[0] for r in out} == {1, 3, 5, 7, 8, 9, 10, 11}
    assert X.credentials(docs_of(rows)).count() == len(out)


def test_user_information_and_key_blocks_by_hand(docs_of):
    block = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nMIIE+/x=\n-----END RSA PRIVATE KEY-----"
    rows = [(1, "see postgres://admin:hunter2secret@host/x now"), (2, f"key\n{block}\nend"), (3, "-----BEGIN PRIVATE KEY----- without an end!"), (4, "https://example.com/a:b@c")]
    out = {r.doc_id: (r.identifier, r.secret, r.endpoint, r.begin, r.end) for r in X.credentials(docs_of(rows)).collect()}
    assert out == {1: ("admin", "hunter2secret", "postgres://admin:hunter2secret@host/x", 4, 41), 2: (None, block, None, 4, 4 + len(block)), 3: (None, "-----BEGIN PRIVATE KEY-----", None, 0, 27)}


def test_repeated_rows_and_two_texts_of_an_id(spark, docs_of):
    one, two = f"{KEY} password=abcdefgh1", f"{KEY} password=abcdefgh2"
    rows = docs_of([(1, one), (1, one), (1, two), (None, one), (2, None)]).selectExpr("*", "1 as th", "2 as kind", "3 as value", "4 as s")
    assert sorted((r.doc_id, r.secret[-1]) for r in X.credentials(rows).collect()) == [(1, "1"), (1, "2")]


def test_settings_by_hand(docs_of):
    token = "ghp_" + "a1B2" * 9
    cases = [
        ('TOKEN = "9233A8BC77"', 'TOKEN = "9233A8BC77'),
        ("Password: abcdefgh1234, then", "Password: abcdefgh1234"),
        ("DB_PASSWORD=hunter2hunter2", "DB_PASSWORD=hunter2hunter2"),
        ('auth_token="abcdefgh1234"', 'auth_token="abcdefgh1234'),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG+bPxRfi", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG+bPxRfi"),
        ("password = P@ssw0rd123.", "password = P@ssw0rd123"),
        ("pwd=a&b;c,d(e)f!", "pwd=a&b;c,d(e)f!"),
        ("password=abcdefgh;host=x", "password=abcdefgh"),
        ("?x-api-key=abcdefgh&page=2", "x-api-key=abcdefgh"),
        ("the keyboard: abcdefgh1234", None),
        ("password: short", None),
    ]
    rows = [(i, f"{KEY} {t}") for i, (t, _) in enumerate(cases)]
    assert {r.doc_id: r.secret for r in X.credentials(docs_of(rows)).collect()} == {i: v for i, (_, v) in enumerate(cases)}
    rows = [(1, "DB_USER=root DB_PASS_TOKEN=abcdefgh12"), (2, '"Login": "bob", "Password": "x#y$z%12"'), (3, f"GITHUB_TOKEN={token}"), (4, f"access_key: {KEY} SECRET: https://example.com/abc")]
    out = {r.doc_id: (r.identifier, r.secret, r.endpoint, r.strength) for r in X.credentials(docs_of(rows)).collect()}
    assert out == {
        1: ("DB_USER=root", "DB_PASS_TOKEN=abcdefgh12", None, "linked"),
        2: ('Login": "bob', 'Password": "x#y$z%12', None, "linked"),
        3: (None, token, None, "strong"),
        4: (KEY, None, "https://example.com/abc", "strong"),
    }


def test_odd_rows(odd, empty):
    assert X.credentials(odd).count() == 0
    assert X.credentials(empty).count() == 0
