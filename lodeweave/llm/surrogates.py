"""Personal data replaced by keyed surrogates of the same type.

Entities are found by patterns with checks (Luhn, mod 97, octets) and brought to a canonical form, so that one
person's number written in two ways is one entity. Its surrogate is a keyed permutation of the form's letters and
digits, each within its own alphabet: a Feistel network on the characters, so entities of one shape never
meet, and length, case, separators, script, issuer digit, country code and check digits are kept. Names are found
after a title or by a given name of the lists. Each given and family name is an entity of its own, drawn from lists by gender and script
with the case of the original, so full, titled and bare mentions of one person in a text agree.

A surrogate must also differ from every entity that occurs, its own included, and names may meet as
the lists are finite. So all distinct entities are kept in a table, and those whose surrogate meets another are
given the next one until none does. Texts are rewritten row by row; the few entities
that needed another try reach their documents by a join on the document, of whatever size Spark finds it.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import pieces, table
from lodeweave.session import discard

KEY = b"surrogates"
ROUNDS = 8

# Alphabets whose letters are permuted among themselves.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
HEX = "0123456789abcdef"
# Given and family names by script and gender, family names by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Rafael Simon Thomas Viktor".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Frieda Greta Helena Irene Julia Karla Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Светлана".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Λεωνίδας Νίκος Παύλος Σπύρος Χρήστος".split(),
    ("latin", "n"): "Alex Casey Charlie Jamie Jordan Kim Morgan Robin Sascha Taylor".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
FAMILY = {
    "latin": "Abel Brandt Costa Duval Ekman Fischer Garcia Horvat Iversen Jansen Keller Lopez Moreau Novak Olsen Pereira Quinn Rossi Silva Toth Ulrich Vidal Weber Young Zeller".split(),
    "cyrillic": "Бондаренко Гончар Доценко Кравец Лысенко Мельник Назаренко Петренко Романенко Шевченко".split(),
    "greek": "Αγγέλου Βλάχος Γεωργίου Δήμου Ιωάννου Κωνσταντίνου Λάμπρου Νικολάου Παππάς".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Signor Sir Господин Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Signora Госпожа Κυρία".split()}
TITLES["n"] = "Dr Prof Professor Doctor".split()
GENDER = {t: g for g, names in TITLES.items() for t in names}
# Given names that show a name without a title, besides those of GIVEN.
COMMON = {
    "m": "John James Robert Michael William David Richard Joseph Charles Christopher Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen "
    "Steven Scott Benjamin Samuel Gregory Alexander Patrick Peter Henry Pierre Jean Jacques Philippe Hans Klaus Wolfgang Juan Carlos Pedro Giovanni Luigi".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Anna Emma "
    "Anne Jane Catherine Marie Sophie Claire Ursula Ingrid Carmen Lucia Giulia Francesca".split(),
}
KNOWN = {n.casefold(): g for names in (*[(g, v) for (_, g), v in GIVEN.items() if g != "n"], *COMMON.items()) for g, v in [names] for n in v}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAP = r"[^\W\d_a-zà-öø-ÿа-яα-ω][\w'’\-]+"
_INITIAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω]\."
_NAME = rf"(?:(?:{_CAP}|{_INITIAL}) ){{0,2}}{_CAP}"
# Country codes whose groups are known come first, so that they end where their numbers do.
_PHONES = [
    r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}", r"\(\d{3}\)[ .\-]?\d{3}[ \-.]\d{4}", r"\d{3}([\-.])\d{3}\1\d{4}", r"(?<!\d[ .,\-])\d{3} \d{3} \d{4}",
    r"\+33[ .\-]?(?:\(0\)[ .\-]?)?\d(?:[ .\-]?\d{2}){4}", r"\+7[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{2}[ .\-]?\d{2}", r"(?<!\d[ .,\-])0[1-9](?:[ .\-]\d{2}){4}",
    r"\+(?!1)\d(?:[ .\-]?\(?\d\)?){7,14}", r"\+(?!1)\d{2,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}",
]
PATTERNS = {
    "email": re.compile(r"(?<![\w.+\-])[\w.+%\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "card": re.compile(r"(?<![\d.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-])"),
    "ip": re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    "ip6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)"),
    "phone": re.compile(rf"(?<![\w+])(?:{'|'.join(_PHONES)})(?!\d)"),
    "ssn": re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"""(?i)(?:token|secret|password|passwd|api[ _\-]?key|access[ _\-]?key)["']?\s*[=:]\s*["']?(?P<v>[A-Za-z0-9_\-+/.]{16,}={0,2})"""),
    "name": re.compile(rf"(?<!\w)(?P<t>{'|'.join(sorted(GENDER, key=len, reverse=True))})\.? (?P<v>{_NAME})"),
}
_DIGITS = re.compile(r"\d[\d\-. ()]{4,}\d")
_COLONS = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]")
_TITLE = re.compile("|".join(GENDER))
_GIVEN = re.compile(rf"(?<!\w){_CAP}(?= )")
_UNTITLED = re.compile(rf"(?:{_CAP}|{_INITIAL}) (?:(?:{_CAP}|{_INITIAL}) )?{_CAP}")
_WORD = re.compile(rf"(?<!\w)(?:{_CAP}|{_INITIAL})")
_OWNED = re.compile(r"(?:['’]s?|-)$")
_OF = {c: a for a in ALPHABETS for c in a}


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, raw: str) -> str | None:
    """The form that stands for an entity however it is written; None if a check fails."""
    if kind == "card":
        digits = re.sub(r"\D", "", raw)
        return digits if _luhn(digits) == 0 and set(digits) != {"0"} else None
    if kind == "iban":
        short = raw.replace(" ", "")
        return short if 15 <= len(short) <= 34 and _mod97(short) == 1 else None
    if kind == "phone":
        return re.sub(r"[^\d+]", "", raw.replace("(0)", ""))
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(raw).exploded.replace(":", "") if re.search(r"\d", raw) else None
        except ValueError:
            return None
    if kind == "ssn":
        return raw.replace("-", "")
    if kind == "email":
        return raw.lower()
    if kind == "secret" and not set(raw.lower()) - set(HEX):
        return raw.lower()
    return raw


def _names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, form) of the names of a text. A form holds a token for each word: ``s:smith``, ``m:john``, ``i:m j.``, or ``I:m john``
    for an initial of a given name of this text."""
    spans = [(*m.span("v"), GENDER[m["t"]]) for m in PATTERNS["name"].finditer(text)] if _TITLE.search(text) else []
    spans += [(*m.span(), KNOWN[g[0].casefold()]) for g in _GIVEN.finditer(text) if g[0].casefold() in KNOWN and (m := _UNTITLED.match(text, g.start()))]
    found, family, given, covered = [], set(), {}, 0
    for a, b, gender in sorted(spans):
        words = [w[0] for w in _WORD.finditer(text, a, b)]
        owned = _OWNED.search(words[-1])
        if a < covered or len(words[-1]) - len(owned[0] if owned else "") < 2:
            continue
        covered = b - len(owned[0]) if owned else b
        words = [w.casefold() for w in words[:-1]] + [words[-1].removesuffix(owned[0] if owned else "").casefold()]
        found.append((a, covered, gender, words))
        family.add(words[-1])
        for w in words[:-1]:
            if not w.endswith(".") and given.get(w, "n") == "n":
                given[w] = gender
    if not found:
        return []

    def token(w: str, gender: str) -> str:
        if w in family:
            return f"s:{w}"
        if w.endswith("."):
            full = next((g for g in given if g[0] == w[0]), None)
            return f"I:{given[full]} {full}" if full else f"i:{gender} {w}"
        return f"{given[w]}:{w}"

    out = [(a, b, "\t".join(token(w, g) for w in words)) for a, b, g, words in found]
    taken = [False] * len(text)
    for a, b, _ in out:
        taken[a:b] = [True] * (b - a)
    for m in _WORD.finditer(text):
        w = _OWNED.sub("", m[0])
        if not taken[m.start()] and (w.casefold() in family or w.casefold() in given):
            out.append((m.start(), m.start() + len(w), token(w.casefold(), "n")))
    return out


def parts(kind: str, form: str) -> list[tuple[str, str]]:
    """The entities that a place holds: given and family names for a name, itself for all else."""
    if kind != "name":
        return [(kind, form)]
    out = []
    for t in form.split("\t"):
        role, w = t.split(":", 1)
        out.append(("family", w) if role == "s" else ("initial", w) if role == "i" else ("given", w) if role == "I" else ("given", f"{role} {w}"))
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order and without overlap."""
    kinds = []
    if "@" in text:
        kinds.append("email")
    if "=" in text or ":" in text:
        kinds.append("secret")
    if _DIGITS.search(text):
        kinds += ["iban", "card", "ip", "phone", "ssn"]
    if _COLONS.search(text):
        kinds.append("ip6")
    out: list[tuple[int, int, str, str]] = []
    for rank, kind in enumerate(kinds):
        for m in PATTERNS[kind].finditer(text):
            a, b = m.span("v") if kind == "secret" else m.span()
            form = canonical(kind, text[a:b])
            if form is not None:
                out.append((a, rank, b, kind, form))
    out += [(a, len(kinds), b, "name", form) for a, b, form in _names(text)]
    found, end = [], 0
    for a, _, b, kind, form in sorted(out):
        if a >= end:
            found.append((a, b, kind, form))
            end = b
    return found


def _stream(key: bytes, *parts) -> bytes:
    seed = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest()
    return hashlib.shake_128(seed).digest(1024)


def permute(text: str, fixed, key: bytes, tweak: str, alphabets=None) -> str:
    """A keyed permutation of the texts of one shape: the characters of known alphabets but those at places
    ``fixed`` change within their alphabet. Each round adds to one half a keyed function of the other."""
    of = alphabets or _OF
    at = [k for k, c in enumerate(text) if c in of and k not in fixed]
    shape = "".join(c if c not in of or k in fixed else of[c][0] for k, c in enumerate(text))
    value = [of[text[k]].index(text[k]) for k in at]
    size = [len(of[text[k]]) for k in at]
    half = len(at) // 2
    parts = (range(half), range(half, len(at)))
    for r in range(ROUNDS):
        this, other = parts[(r + 1) % 2], parts[r % 2]
        if not len(this):
            continue
        pad = _stream(key, tweak, shape, r, [value[k] for k in other])
        for n, k in enumerate(this):
            j = 2 * n % 1022
            value[k] = (value[k] + pad[j] + 256 * pad[j + 1] + n // 511) % size[k]
    out = list(text)
    for k, v in zip(at, value):
        out[k] = of[text[k]][v]
    return "".join(out)


_HEX_OF = dict.fromkeys(HEX, HEX)


def surrogate(kind: str, form: str, key: bytes = KEY, turn: int = 0) -> str:
    """The canonical form of the replacement; ``turn`` counts the tries before."""
    tweak = f"{kind}:{turn}"
    if kind == "card":
        body = permute(form[:-1], {0}, key, tweak)
        return next(body + d for d in "0123456789" if _luhn(body + d) == 0)
    if kind == "iban":
        body = permute(form[4:], (), key, tweak)
        return f"{form[:2]}{98 - _mod97(form[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        cc = 0 if not form.startswith("+") else 2 if form[1] in "17" else 3
        fiction = range(len(form) - 7, len(form) - 4) if form[-7:-4] == "555" else ()
        return permute(form, {*range(cc), *fiction}, key, tweak)
    if kind == "ip":
        return ".".join(str(ord(c)) for c in permute("".join(map(chr, map(int, form.split(".")))), (), key, tweak, _BYTE_OF))
    if kind == "ip6":
        # Groups of zeros and the first group stay, if there is another one.
        zero = {k for k in range(32) if form[k // 4 * 4 : k // 4 * 4 + 4] == "0000"}
        first = set(range(4)) if len(zero | {0, 1, 2, 3}) < 32 else set()
        return permute(form, zero | first, key, tweak, _HEX_OF)
    if kind in ("given", "family", "initial"):
        gender, _, name = form.rpartition(" ")
        script = "cyrillic" if re.search("[а-я]", name) else "greek" if re.search("[α-ω]", name) else "latin"
        names = FAMILY[script] if kind == "family" else GIVEN.get((script, gender)) or GIVEN[script, "m"]
        pick = names[int.from_bytes(_stream(key, tweak, form)[:4]) % len(names)]
        # Later tries leave the lists by added letters, so there is always another one.
        tail = permute("a" * turn, (), key, f"{tweak}:{form}") if turn else ""
        return f"{gender} {pick}{tail}".strip().casefold()
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2:-1] == ["example"] else 1
        fixed = range(len(form) - len(".".join(labels[-kept:])), len(form))
        return permute(form, set(fixed), key, tweak)
    if kind == "secret" and not set(form) - set(HEX):
        return permute(form, (), key, tweak, _HEX_OF)
    if kind == "name":
        gender, name = form.split(" ", 1)
        script = "cyrillic" if re.search("[а-я]", name) else "greek" if re.search("[α-ω]", name) else "latin"
        pad = _stream(key, tweak, form)
        given, family = GIVEN[script, gender], FAMILY[script]
        a, b = given[int.from_bytes(pad[:4]) % len(given)], family[int.from_bytes(pad[4:8]) % len(family)]
        # Later tries leave the lists by an added letter, so there is always another one.
        tail = permute("a" * (turn // 4), (), key, f"{tweak}:{form}") if turn >= 4 else ""
        return f"{gender} {f'{a} {b}{tail}' if ' ' in name else f'{b}{tail}'}".casefold()
    return permute(form, (), key, tweak)


_BYTE_OF = dict.fromkeys(map(chr, range(256)), "".join(map(chr, range(256))))


def written(kind: str, raw: str, form: str) -> str:
    """A surrogate's form written like ``raw``: its separators, its case."""
    if kind == "name":
        name = form.split(" ", 1)[1]
        return name.upper() if raw.isupper() else name.title()
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(form.replace("+", ""))
        trunk = raw.replace("(0)", "(\0)") if kind == "phone" else raw
        return "".join(next(rest, "") if c.isalnum() else c for c in trunk).replace("\0", "0")
    if kind == "ip6":
        address = ipaddress.IPv6Address(":".join(form[k : k + 4] for k in range(0, 32, 4)))
        new = str(address) if "::" in raw else address.exploded if len(raw) == 39 else ":".join(f"{int(x, 16):x}" for x in address.exploded.split(":"))
        return new.upper() if raw != raw.lower() else new
    if kind in ("email", "secret") and raw != raw.lower() and form == form.lower():
        return "".join(c.upper() if k < len(raw) and raw[k].isupper() else c for k, c in enumerate(form))
    return form


def called(raw: str, form: str, new: list[str]) -> str:
    """A name of the surrogates ``new`` of its words."""
    out = []
    for t, word, x in zip(form.split("\t"), _WORD.findall(raw), new):
        x = x.rpartition(" ")[2]
        out.append(f"{x[0].upper()}." if t[0] in "iI" else x.upper() if word.isupper() else x.title())
    return " ".join(out)


def rewrite(text: str, key: bytes, turns: dict[tuple[str, str], int], memo: dict) -> tuple[str, int]:
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, form in found:
        new = []
        for entity in parts(kind, form):
            turn = turns.get(entity, 0)
            if (*entity, turn) not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[*entity, turn] = surrogate(*entity, key, turn)
            new.append(memo[*entity, turn])
        out += [text[at:a], called(text[a:b], form, new) if kind == "name" else written(kind, text[a:b], new[0])]
        at = b
    return "".join([*out, text[at:]]), len(found)


_SEEN = "rid long, did long, kind string, form string"


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entity of each text once."""
    for batch in pieces(batches, "text"):
        rows = []
        for rid, did, text in zip(*[batch.column(c).to_pylist() for c in ("rid", "did", "text")]):
            rows += [(rid, did, kind, form) for kind, form in dict.fromkeys(e for _, _, k, f in find(text or "") for e in parts(k, f) if e[0] != "initial")]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["rid", "did", "kind", "form"])


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, form, turn, new)``: distinct entities with surrogates that differ from each other and from every
    entity of their kind. The least form of those that meet keeps its surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, f, key, t) for k, f, t in zip(*[batch.column(c).to_pylist() for c in ("kind", "form", "turn")])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "form", "turn", "new"])

    schema = "kind string, form string, turn int, new string"
    forms = entities.select("kind", "form").distinct()
    state = table(forms.withColumn("turn", F.lit(0)).mapInArrow(run, schema), "surrogates")
    while True:
        real = state.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
        first = state.groupBy("kind", "new").agg(F.min("form").alias("first"), F.count("*").alias("owners"))
        taken = table(first.join(real, ["kind", "new"], "left").where("owners > 1 or real").select("kind", "new", F.when(F.col("real"), None).otherwise(F.col("first")).alias("first")), "taken")
        if taken.isEmpty():
            return state
        met = state.join(taken, ["kind", "new"], "left_semi").join(taken, ["kind", "new"]).where("first is null or form <> first").select("kind", "form", (F.col("turn") + 1).alias("turn"))
        again = table(met.mapInArrow(run, schema), "again")
        merged = table(state.join(again, ["kind", "form"], "left_anti").unionByName(again), "surrogates")
        for old in (state, taken, again):
            discard(old)
        state = merged


def replace(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``_pii_found``, the number of places replaced (0 for null texts)."""
    own = docs.columns
    # Copies of a row hold the same entities, so rows are followed by their id and text.
    keyed = docs.withColumns({"_pii_r": F.xxhash64(F.col("text").cast("string")), "_pii_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    texts = keyed.select(F.col("_pii_r").alias("rid"), F.col("_pii_d").alias("did"), F.col("text").cast("string").alias("text"))
    seen = table(texts.mapInArrow(_entities, _SEEN), "entities")
    other = table(assign(seen, key).where("turn > 0").select("kind", "form", "turn"), "turns")
    if other.isEmpty():
        joined = keyed.withColumn("_pii_turns", F.lit(None).cast("array<struct<kind:string,form:string,turn:int>>"))
    else:
        turns = seen.join(other, ["kind", "form"]).groupBy(F.col("rid").alias("_pii_r"), F.col("did").alias("_pii_d")).agg(F.collect_set(F.struct("kind", "form", "turn")).alias("_pii_turns"))
        joined = keyed.join(table(turns, "turns_of"), ["_pii_r", "_pii_d"], "left")
    rows = joined.select(*[F.col(f"`{c}`") for c in own], "_pii_turns")
    text_at = own.index("text")
    schema = rows.drop("_pii_turns").withColumn("text", F.col("text").cast("string")).withColumn("_pii_found", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in pieces(batches, "text"):
            new, n = [], []
            for text, turns in zip(batch.column("text").to_pylist(), batch.column("_pii_turns").to_pylist()):
                got = (None, 0) if text is None else rewrite(text, key, {(t["kind"], t["form"]): t["turn"] for t in turns or ()}, memo)
                new.append(got[0])
                n.append(got[1])
            cols = list(batch.columns)[: len(own)]
            cols[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*own, "_pii_found"])

    return rows.mapInArrow(run, schema)


def hide(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(doc_id, text, n_found)``: every text with its personal data replaced.

    The same entity gets the same surrogate in all texts, different ones different surrogates. Null texts
    stay null; texts without an entity are unchanged to the byte. Repeated rows stay; other columns are ignored.
    """
    return replace(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key).withColumnRenamed("_pii_found", "n_found")


def hide_rows(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; all else is kept."""
    return replace(docs, key).drop("_pii_found")
