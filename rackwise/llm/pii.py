"""Personal data: detected entities get keyed surrogates of the same type, checked against collisions in the corpus."""

from __future__ import annotations

import re
import string
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, any_names, stored, without

# Titles with the gender they tell, common given names, and syllables of made-up names.
TITLES = {
    "m": "Mr Mister Herr Monsieur Señor Sr Господин",
    "f": "Mrs Ms Miss Mme Mlle Frau Madame Mademoiselle Señora Señorita Sra Srta Госпожа",
    "n": "Dr Prof Professor Mx Доктор",
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Hans Jürgen Wolfgang Klaus Stefan Jean "
         "Pierre François Jacques Philippe Carlos José Miguel Javier Иван Сергей Дмитрий Алексей Николай",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Emily Ursula Sabine Monika Petra Claudia "
         "Marie Françoise Isabelle Nathalie Sophie Carmen María Lucía Pilar Анна Ольга Елена Татьяна Наталья",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бе бо да де до га ге ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο γα γε δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": {"m": "n r s l d".split(), "f": "a ia ina".split()}, "cyrillic": {"m": "н р с л д".split(), "f": "а ия ина".split()}, "greek": {"m": "ς ν".split(), "f": "α η".split()}}

_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_TITLE = {t: g for g, names in TITLES.items() for t in names.split()}
_GIVEN = {t: g for g, names in GIVEN.items() for t in names.split()}


def _any(words: dict[str, str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))


PERSON = re.compile(
    rf"\b(?:(?P<title>{_any(_TITLE)})(?:\.\x20?|\x20)(?P<first>{_NAME}|[A-Z]\.)(?:\x20(?P<rest>{_NAME}(?:\x20{_NAME})?))?"
    rf"|(?P<given>{_any(_GIVEN)})\x20(?:(?P<middle>[A-Z]\.)\x20)?(?P<last>{_NAME}))\b")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b")
NUMBERS = re.compile(
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w-]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?))(?!\w)"
    r"|(?<![\w.+-])(?P<card>\d{4}(?:[\x20-]?\d{4}){3}(?:\d{1,3})?|\d{4}[\x20-]?\d{6}[\x20-]?\d{5})(?![\w-])"
    r"|(?<![\w.])(?P<phone>\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}[/\x20-]\d{3,4}[\x20-]?\d{3,5})(?!\w)"
)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]+(?!\w|\.\d)")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX = re.compile("[0-9A-Fa-f]+")
_DIGIT = re.compile("[0-9]")
_CAPITAL_START = re.compile(rf"\b(?:{_any(_TITLE | _GIVEN)})\b")


class Draws:
    """A stream of numbers that only the key, the entity and the attempt determine."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int) -> None:
        self.seed = f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass")
        self.key, self.turn, self.pool = key.encode()[:64], 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 4:
            self.pool = int.from_bytes(blake2b(self.seed + self.turn.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.turn, self.left = self.turn + 1, 60
        self.left -= 4
        self.pool, x = divmod(self.pool, 1 << 32)
        return x % n

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case; all else stays."""
        return "".join(
            string.digits[self.below(10)] if "0" <= c <= "9" else string.ascii_lowercase[self.below(26)] if "a" <= c <= "z"
            else string.ascii_uppercase[self.below(26)] if "A" <= c <= "Z" else c for c in text)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    doubled = [int(d) * (2 - i % 2) if i % 2 == 0 else int(d) for i, d in enumerate(digits[-2::-1])]
    return (sum(d - 9 if d > 9 else d for d in doubled) + int(digits[-1])) % 10


def script(name: str) -> str:
    for c in name:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def surrogate(key: str, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form that takes the place of ``canonical``: the same kind, script, gender and number of digits."""
    draws = Draws(key, kind, canonical, attempt)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        names, _, top = domain.rpartition(".")
        # Addresses of one domain stay together.
        return f"{draws.like(local)}@{Draws(key, 'domain', domain, 0).like(names)}.{top}"
    if kind == "ip":
        parts = []
        for octet in canonical.split("."):
            low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[len(octet) if attempt < 32 else 1 + draws.below(3)]
            parts.append(str(low + draws.below(high - low + 1)))
        return ".".join(parts)
    if kind == "ip6":
        # A zero stays zero, so that the short form has the same gaps; other groups keep their number of digits.
        groups = []
        for group in canonical.split(":"):
            digits = len(group.lstrip("0"))
            if digits:
                digits = digits if attempt < 32 else 1 + draws.below(4)
                low = 16 ** (digits - 1)
                group = f"{low + draws.below(16 ** digits - low):04x}"
            groups.append(group)
        return ":".join(groups)
    if kind == "card":
        body = canonical[0] + draws.like(canonical[1:-1])
        check = next(d for d in string.digits if luhn(body + d) == 0)
        return body + (check if luhn(canonical) == 0 else string.digits[(int(check) + 1 + draws.below(9)) % 10])
    if kind == "phone":
        kept = 1 + canonical.startswith("+")
        return canonical[:kept] + draws.like(canonical[kept:])
    if kind == "ssn":
        return "9" + draws.like(canonical[1:])
    if kind == "iban":
        body = draws.like(canonical[4:])
        number = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00"))
        return f"{canonical[:2]}{98 - number % 97:02d}{body}"
    # given-m, given-f, given-n, surname
    tongue = script(canonical)
    syllables, endings = SYLLABLES[tongue], ENDINGS[tongue]
    gender = kind[-1] if kind != "surname" else "m"
    ends = endings.get(gender) or endings["m"] + endings["f"]
    n = 2 + (kind == "surname") + attempt // 8
    return "".join(syllables[draws.below(len(syllables))] for _ in range(n)) + ends[draws.below(len(ends))]


def _cased(like: str, name: str) -> str:
    return name.upper() if len(like) > 1 and like.isupper() else name[:1].upper() + name[1:]


def _laid_out(surface: str, canonical: str) -> str:
    """The characters of ``canonical`` in the places that the surface's letters and digits hold."""
    chars = iter(c for c in canonical if c.isalnum())
    return "".join(next(chars, "") if c.isalnum() else c for c in surface)


def _address(body: str) -> str | None:
    """All eight groups of an IPv6 address; None for other runs of colons, and for what names no one (``::``, ``::1``).

    A short form needs a first group of four digits or three groups that aren't zero, so that a slice like 1::2 is none.
    """
    try:
        address = IPv6Address(body)
    except AddressValueError:
        return None
    groups = address.exploded.split(":")
    written = sum(g != "0000" for g in groups)
    clear = "::" not in body or written >= 3 or written == 2 and body.find(":") == 4
    return address.exploded if clear and not address.is_loopback and not address.is_unspecified else None


def _address_laid_out(surface: str, canonical: str) -> str:
    """The groups of ``canonical`` that aren't zero in place of the surface's, as wide and in the same case."""
    groups = iter(g.lstrip("0") for g in canonical.split(":") if g != "0000")
    upper = any(c in "ABCDEF" for c in surface)
    shown = _HEX.sub(lambda m: next(groups).rjust(len(m[0]), "0") if m[0].strip("0") else m[0], surface)
    return shown.upper() if upper else shown


def _person(m: re.Match) -> list[tuple[int, int, str, str]]:
    """Spans of a person's names with their kinds and canonical forms; initials and titles stay."""
    if m["given"]:
        parts = [(m.start("given"), m["given"], f"given-{_GIVEN[m['given']]}"), (m.start("last"), m["last"], "surname")]
    else:
        gender = _TITLE[m["title"]]
        first = m["first"]
        if first[-1] == "." or m["rest"]:
            gender = _GIVEN.get(first, gender)
            parts = [] if first[-1] == "." else [(m.start("first"), first, f"given-{gender}")]
            at = m.start("rest")
            for name in (m["rest"] or "").split(" "):
                if name:
                    parts.append((at, name, "surname"))
                at += len(name) + 1
        else:
            parts = [(m.start("first"), first, "surname")]
    return [(at, at + len(name), kind, name.casefold()) for at, name, kind in parts]


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, canonical form) of every entity, ascending; earlier and longer ones win over those they overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            kind, body = m.lastgroup, m[0]
            if kind == "ip":
                if max(map(int, body.split("."))) < 256:
                    found.append((m.start(), m.end(), kind, body))
                continue
            canonical = "".join(c for c in body if c.isalnum())
            found.append((m.start(), m.end(), kind, "+" * (kind == "phone" and body[0] == "+") + canonical))
    if _COLONS.search(text):
        for m in IPV6.finditer(text):
            body = m[0][:-1] if m[0][-1] == ":" and m[0][-2:] != "::" else m[0]
            canonical = _address(body)
            if canonical:
                found.append((m.start(), m.start() + len(body), "ip6", canonical))
    if _CAPITAL_START.search(text):
        for m in PERSON.finditer(text):
            found += _person(m)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def rewrite(text: str, key: str, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with its entities replaced, and their kinds in order."""
    at, pieces, kinds = 0, [], []
    for start, stop, kind, canonical in find_entities(text):
        new = surrogate(key, kind, canonical, attempts.get((kind, canonical), 0))
        surface = text[start:stop]
        if kind in ("email", "ip"):
            shown = new.upper() if surface.isupper() and kind == "email" else new
        elif kind.startswith("given") or kind == "surname":
            shown = _cased(surface, new)
        elif kind == "ip6":
            shown = _address_laid_out(surface, new)
        else:
            shown = _laid_out(surface, new)
        pieces += [text[at:start], shown]
        kinds.append(kind)
        at = stop
    return "".join([*pieces, text[at:]]), kinds


def settle(entities: DataFrame, key: str, most_rounds: int = 96) -> DataFrame:
    """``kind``, ``canonical``, ``attempt`` and ``surrogate`` of each distinct entity of ``entities`` (``kind``, ``canonical``).

    An attempt fails if the surrogate is itself an entity of the corpus, has been given away, or is
    drawn by an entity that sorts first in the same round; then the next attempt is drawn. Surrogates
    end up distinct within their kind.
    """
    fields = [T.StructField("surrogate", T.StringType())]
    open_ = stored(entities.distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    real = open_.select("kind", F.col("canonical").alias("surrogate"))
    done = None
    for attempt in range(most_rounds):
        drawn = add_columns(open_, lambda: lambda k, c, a: [[surrogate(key, *x) for x in zip(k, c, a, strict=True)]], ["kind", "canonical", "attempt"], fields)
        drawn = stored(drawn, "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        good = drawn.join(first, ["kind", "surrogate", "canonical"], "left_semi").join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done, ["kind", "surrogate"], "left_anti")
        good = stored(good, "pii-good").select("kind", "canonical", "attempt", "surrogate")
        done = good if done is None else done.unionByName(good)
        open_ = stored(drawn.join(good, ["kind", "canonical"], "left_anti").select("kind", "canonical", F.lit(attempt + 1).alias("attempt")), "pii-open")
        if open_.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates after {most_rounds} attempts")


@any_names("text")
def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in ``text``; add ``n_entities`` and ``kinds`` (of the entities, in order).

    Found are e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment cards, US social security
    numbers, IBANs, and names after a title or a common given name. Each gets a surrogate drawn from
    ``key`` and its canonical form: the same type, number of digits and layout, valid check digits
    where the original's are valid, and for names the same script, gender and case. One entity has
    one surrogate in all documents, however it is written. Spark gathers the distinct entities and
    settles collisions (see ``settle``), so that different entities stay different and no surrogate is
    another real entity. Only entities that needed a second draw are joined back to the texts.

    A null text stays null with no entities, texts without entities stay as they are. Texts are read
    whole. Repeated rows get the same replacement. Empty table: no rows. Columns named
    ``n_entities`` and ``kinds`` are replaced, all others kept.
    """
    kept = without(docs, ["n_entities", "kinds"])
    body = kept.withColumn("_body", F.col(text).cast("string")).withColumn("_key", F.xxhash64("_body"))
    pair = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType())]))

    def pairs(texts: list) -> list:
        return [[[{"kind": k, "canonical": c} for k, c in sorted({x[2:] for x in find_entities(t)})] for t in texts]]

    found = add_columns(body.where("_body is not null").select("_key", "_body"), lambda: pairs, ["_body"], [T.StructField("found", pair)], ["_body"])
    found = stored(found.select("_key", F.explode("found").alias("e")).select("_key", "e.kind", "e.canonical"), "pii-found")
    again = stored(settle(found.select("kind", "canonical"), key).where("attempt > 0"), "pii-again")
    shape = "array<struct<kind:string,canonical:string,attempt:int>>"
    if again.isEmpty():
        rows = body.withColumn("_again", F.array().cast(shape))
    else:
        per_text = found.distinct().join(again, ["kind", "canonical"]).groupBy("_key").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("_again"))
        rows = body.join(stored(per_text, "pii-texts"), "_key", "left")

    def written(texts: list, agains: list) -> list:
        out: list[list] = [[], [], []]
        for t, a in zip(texts, agains, strict=True):
            new, kinds = (None, []) if t is None else rewrite(t, key, {(x["kind"], x["canonical"]): x["attempt"] for x in a or ()})
            out[0].append(new)
            out[1].append(len(kinds))
            out[2].append(kinds)
        return out

    fields = [T.StructField("_new", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
    done = add_columns(rows, lambda: written, ["_body", "_again"], fields, ["_body", "_again", "_key"])
    columns = [F.col("_new").alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns]
    return done.select(*columns, "n_entities", "kinds")
