"""Base spans against the plain patterns; added spans; odd rows."""

import random
import re

from docfathom.llm import pii
from tests.llm.conftest import ODD

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans():
    r = random.Random(3)
    letters = "0123456789.+@ -()ab_%é4111"
    for _ in range(20_000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert pii.joined(pii.base_spans(text)) == plain(text), text


def test_find(docs_of):
    secrets = [f'see token = "{random.Random(k).getrandbits(160):040x}" there' for k in range(30)]
    numbers = [f"well {random.Random(k).randrange(10**15, 10**16)} then" for k in range(30)]
    texts = [*secrets, *numbers, "write to ann.lee+x@mail.example.org or 10.0.0.255", "call +1 (234) 555-0199 now", "4111 1111 1111 1111", *ODD]
    rows = {r.doc_id: r for r in pii.find(docs_of(texts)).collect()}
    assert all(rows[k].spans.startswith("secret:") for k in range(30))
    assert (rows[60].n_email, rows[60].n_ip, rows[61].n_phone, rows[62].n_card) == (1, 1, 1, 1)
    assert len(rows) == len(texts) and rows[63].spans == "" and rows[63].n_email == 0
    assert pii.redact(texts[62], pii.base_spans(texts[62])) == "[CARD]"
    assert pii.find(docs_of(["a"]).limit(0)).count() == 0


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "+" * 200_000, "1.2." * 50_000):
        pii.candidates(text, pii.base_spans(text))
