"""Share of documents with planted personal data or secrets that operator 8 finds, and of clean ones that it leaves alone."""

import random
import string
from collections import Counter

from pitwell.llm import pii

r = random.Random(17)
SYLLABLES = [a + b for a in "bcdfghlmnprstv" for b in "aeiou"]


def word():
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))


def prose(n):
    """Invented words with numbers that are nobody's: years, prices, versions, sums, long ones that fail a card's checksum."""
    number = some(string.digits, 16)
    while pii.luhn(number):
        number = some(string.digits, 16)
    plain = [word(), word(), word(), word(), str(r.randint(1, 2030)), f"{r.randint(1, 99)}.{r.randint(10, 99)}", f"v{r.randint(1, 9)}.{r.randint(0, 9)}", number, f"{r.randint(300, 999)}.1.2.3"]
    # A word stands between two numbers; digits that touch over a space are one number by the fixed patterns.
    return " ".join(f"{r.choice(plain)} {word()}" if r.random() < 0.1 else word() for _ in range(n))


def some(alphabet, n):
    return "".join(r.choices(alphabet, k=n))


def card():
    d = r.choice(["4", "51", "37", "6011"])
    d += some(string.digits, 15 - len(d))
    return next(x for x in (d + c for c in string.digits) if pii.luhn(x))


def grouped(d):
    return r.choice([d, "-".join(d[i : i + 4] for i in range(0, 16, 4)), " ".join(d[i : i + 4] for i in range(0, 16, 4))])


def phone():
    a, b, c = some("23456789", 3), some("23456789", 3), some(string.digits, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}", f"+44 {a[:2]} {c} {some(string.digits, 4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"])


def secret():
    long = some(string.ascii_letters + string.digits, 40)
    return r.choice([f"AKIA{some(string.ascii_uppercase + string.digits, 16)}", f"ghp_{long[:36]}", f"api_key = '{long}'", f"password: {long[:20]}", f"token={some('0123456789abcdef', 40)}"])


KINDS = {
    "email": lambda: r.choice(["{0}.{1}@{2}.{3}", "{0}{4}@{2}.{3}", "{0} (at) {2} (dot) {3}", "{0}.{1} [at] {2}.{3}"]).format(word(), word(), word() + word(), r.choice(["com", "org", "de", "io"]), r.randint(1, 99)),
    "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
    "card": lambda: grouped(card()),
    "phone": phone,
    "secret": secret,
}
LEADS = {"email": ["write to", "contact", "my mail is", ""], "ip": ["from host", "login from", "server", ""], "card": ["paid with card", "visa", ""], "phone": ["call", "phone", "tel", ""], "secret": ["", "use", "in the config:"]}


def test_planted_documents(spark):
    planted, clean = [], [prose(r.randint(20, 200)) for _ in range(600)]
    for kind, make in KINDS.items():
        planted += [(kind, f"{prose(r.randint(5, 80))} {r.choice(LEADS[kind])} {make()} {word()} {prose(r.randint(5, 80))}") for _ in range(120)]
    texts = [t for _, t in planted] + clean
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = Counter(k for i, (k, _) in enumerate(planted) if got[i].n_found)
    share = {k: found[k] / 120 for k in KINDS}
    wrong = sum(got[len(planted) + i].n_found > 0 for i in range(len(clean))) / len(clean)
    print(share, wrong)
    assert sum(found.values()) / len(planted) >= 0.9 and min(share.values()) >= 0.8 and wrong <= 0.02
