"""Generated findings with labels, which the forest of secretscan is trained from where no table of them is given.

What is a secret here: random tokens with and without an issuer's prefix, random values
that are assigned to names of secrets, key blocks, passwords in addresses. What is not:
words, names, paths, placeholders, dates, numbers, addresses, hashes and ids.
"""

from __future__ import annotations

import random


def labelled_findings(words, n: int = 8000, seed: int = 7) -> list[tuple[str, str, str, str, bool]]:
    """Findings with labels: candidate, path, text before, text after, whether it is a secret. words: a dictionary."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda a=3, b=12: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "que", "ment", "ung", "sch", "eau", "ción"[:2]]) for _ in range(r.randint(a, b) // 2 + 1))
    of = lambda letters, a, b=None: "".join(r.choice(letters) for _ in range(r.randint(a, b or a)))
    text = lambda: " ".join(word() for _ in range(r.randint(2, 6))) + r.choice([" ", " ", ". ", ", "])
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key"]
    path = lambda: r.choice(["src0", "web", "app/config.py", "server.yml", "tests/test_app.py", "docs/example.md", "main.go", "", "forum", "src12"])
    hexa, base = "0123456789abcdef", upper + lower + digits
    marks = "!@#$%^&*?~+-_.,;:()[]{}<>|/"
    strong = lambda: "".join(r.sample(t := of(base, 6, 18) + of(marks, 2, 5), len(t)))
    glues = ["=", " = \"", ": ", "='", ": '", ":\t", "=\t", " =>  '", " => \"", " := \"", "=     ", ":        "]
    secrets = [
        lambda: (strong(), text() + r.choice([*names, "pwd", "db_pass", "db_password"]) + r.choice(glues)),
        lambda: (of(base, 9, 30), text() + r.choice([*names, "pwd", "db_pass"]) + r.choice(glues)),
        lambda: (r.choice(["AKIA", "ASIA"]) + of(upper + digits, 16), r.choice([text(), "aws_access_key_id = ", text() + "key "])),
        lambda: (r.choice(["ghp_", "gho_", "ghs_"]) + of(base, 36), r.choice([text(), "token: "])),
        lambda: ("xoxb-" + of(digits, 11) + "-" + of(base, 24), text()),
        lambda: ("AIza" + of(base + "_-", 35), text()),
        lambda: ("sk_live_" + of(base, 24), text()),
        lambda: ("eyJ" + of(base + "_-", 30, 120), r.choice([text(), "authorization bearer "])),
        lambda: (of(hexa, r.choice([16, 18, 20, 24, 32, 40, 64])), text() + r.choice(names) + r.choice(["=", " = \"", ": ", "='"])),
        lambda: (of(base, 16, 44), text() + r.choice(names) + r.choice(["=", " = \"", ": ", "='"])),
        lambda: (of(base + "+/", 40), text() + "aws_secret_access_key = "),
        lambda: (of(base, 9, 15), text() + r.choice(["password", "passwd", "pwd", "secret"]) + r.choice(["=", ": "])),
    ]
    issuer = lambda: of(lower, 2, 6) + r.choice(["_", "-", "."])
    block = lambda: "\n".join(of(base + "+/", 64) for _ in range(r.randint(3, 25)))
    secrets += [
        lambda: (issuer() + of(base, 20, 44), r.choice([text(), text() + r.choice(names) + r.choice(glues)])),
        lambda: (issuer() + of(base, 8, 24) + r.choice([".", "-", "_"]) + of(base + "_-", 12, 44), r.choice([text(), text() + r.choice(names) + r.choice(glues)])),
        lambda: ("eyJ" + of(base + "_-", 15, 60) + "." + of(base + "_-", 20, 120) + "." + of(base + "_-", 20, 60), r.choice([text(), "authorization bearer "])),
        lambda: (r.choice([strong(), of(base, 6, 16), word() + of(digits, 1, 4)]), text() + r.choice(["postgres", "mysql", "amqp", "redis", "https", "ftp"]) + "://" + word() + ":"),
        lambda: (word(4, 8)[:8] + of(digits, 1, 4), text() + r.choice(["password", "passwd", "pwd", "pass"]) + r.choice(glues)),
        lambda: (f"-----BEGIN {(k := r.choice(['RSA ', 'EC ', '', 'OPENSSH ', 'ENCRYPTED ']))}PRIVATE KEY-----\n{block()}\n-----END {k}PRIVATE KEY-----", r.choice([text(), "key: "])),
        lambda: (f"-----BEGIN {r.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----", text()),
    ]
    plain = [
        lambda: (word(6, 12) + "-" + of(hexa, r.choice([7, 8, 12, 20])) + r.choice([".js", ".css", ".min.js", ""]), text() + r.choice(["src=\"", "file: ", "load "])),
        lambda: (word().capitalize() + word().capitalize() + word().capitalize() + r.choice(["", "Impl", "Factory", "Test"]) + of(digits, 0, 2), text()),
        lambda: (word(4, 9) + of(digits, 1, 4), text() + r.choice(["name", "user", "file", "version", word()]) + r.choice(glues)),
        lambda: (word(3, 8).lower() + "_" + word(3, 8).lower() + "_" + word(3, 8).lower(), text() + r.choice(glues)),
        lambda: (" ".join(word() for _ in range(r.randint(2, 8))) + r.choice(["", ".", "!", "?"]), text() + r.choice([word(), "title", "name", "secret", "password"]) + r.choice(glues)),
        lambda: (word(8, 16).ljust(7, "a") + r.choice([")", "!", "?", "'s", "/" + word(), "-" + word(), "(" + word() + ")", ":" + word(), "," + word()]), text().rstrip() + r.choice([*glues, ": "])),
        lambda: ("//" + word() + ".example" + r.choice(["", "/" + word(), "/" + word() + "?" + word() + "=" + of(digits, 1, 5)]), text() + r.choice(["http:", "https:"])),
        lambda: (r.choice(["${" + word().upper() + "}", "<your-" + word() + ">", "{{ " + word() + " }}", "os.environ['" + word() + "']", "get_" + word() + "()", "********"]).ljust(8, "*"), text() + r.choice(names) + r.choice(glues)),
        lambda: (word() + "@" + word() + ".example", text() + r.choice(["mail", "user", "from", word()]) + r.choice(glues)),
        lambda: (of(digits, 2) + ":" + of(digits, 2) + ":" + of(digits, 2), text() + r.choice(["time: ", "at: ", "date="])),
        lambda: (of(hexa, 40), text() + r.choice(["commit ", "revision ", "sha1: ", "sha1="])),
        lambda: (of(hexa, r.choice([32, 64])), text() + r.choice(["md5 ", "checksum: ", "sha256=", "digest: ", "etag: \"", "integrity="])),
        lambda: ("-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), text() + r.choice(["", "id=", "uuid: "])),
        lambda: (word(16, 30).ljust(16, "e"), text()),
        lambda: (word(16, 30).upper().ljust(16, "E"), text()),
        lambda: ("/".join(word() for _ in range(r.randint(3, 6))) + "/" + of(digits, 4, 7), text() + r.choice(["http://", "path: ", ""])),
        lambda: ("-".join(word() for _ in range(r.randint(3, 6))) + "-" + of(digits, 1, 4), text()),
        lambda: ("_".join(word() for _ in range(r.randint(3, 5))) + of(digits, 1, 3), text()),
        lambda: (word(10, 24) + of(digits, 1, 4) + "padded-out", text()),
        lambda: (of(digits, r.choice([8, 10, 13, 16])), text() + r.choice(["phone: ", "card: ", "order=", "isbn: ", "id: "])),
        lambda: (r.choice(common) + r.choice(common) + "value", text() + r.choice(names) + r.choice(["=", ": "])),
        lambda: (word(8, 16).ljust(8, "a"), text().rstrip() + r.choice([": ", "="])),
        lambda: (of(digits, 4) + "-" + of(digits, 2) + "-" + of(digits, 2) + "T" + of(digits, 6) + "Z", text() + r.choice(["", "date: "])),
    ]
    common = sorted(words)
    out = []
    for i in range(n):
        label = i % 2 == 0
        candidate, before = r.choice(secrets if label else plain)()
        out.append((candidate, path(), before, r.choice(["", " ", "\" "]) + text(), label))
    return out
