"""PII surrogates: keyed, type-consistent replacements that keep distinct entities distinct and coreferent ones alike.

An entity is known by its canonical form (digits of a number, lower-case address), so each way of writing it
gets the same surrogate, put back into the form at hand: separators, letter case, script and gender stay. A
surrogate is a keyed permutation of the entity's own format class (two halves add keyed functions of each other
modulo the sizes of their alphabets), so different entities of a class cannot meet. What a permutation can't
rule out, a surrogate that is another entity of the corpus, or a meeting of generated names, is found by a
distributed collision check over all distinct entities and drawn again until none is left. In a class of which
the corpus fills more than a quarter no draw could avoid its other entities; there the permutation itself is
turned into one cycle through the class, which keeps entities distinct and moves each of them.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved

# Given names by script and gender, and the titles that announce a family name.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amelia Anna Anne Barbara Carla Catherine Charlotte Claire Elena Elizabeth Emily Emma Eva Fatima Francesca Giulia Greta Hannah Helen Isabel Jane Julia Karen Lakshmi Laura Linda Lucia Maria Marie Martha Mary Mei Monica Nina Olivia Paula Priya Rachel Rosa Sarah Sofia Susan Teresa Victoria Yuki".split(),
    ("latin", "m"): "Adam Ahmed Albert Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christian Daniel David Edward Eric Felix Francis Frank George Henry Hans Hiroshi Hugo Jack James Javier Jean John José Joseph Juan Karl Klaus Lucas Luigi Mark Martin Michael Mohammed Oliver Paul Peter Pierre Raj Richard Robert Thomas Wei William".split(),
    ("cyrillic", "f"): "Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Софья Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Константин Михаил Николай Павел Пётр Сергей".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κωνσταντίνος Νίκος Παύλος Πέτρος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Господин Госпожа Κύριος Κυρία".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γο δα δε δο θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}

# Words in small letters that may stand before a family name.
PARTICLES = "al bin da de del della den der di du el ibn la le ten ter van von".split()
# Endings by which generated given names show script and gender.
ENDINGS = {
    ("latin", "f"): "a elle ette ina".split(), ("latin", "m"): "an ert o us".split(), ("cyrillic", "f"): "а ина ия".split(),
    ("cyrillic", "m"): "ий ор слав".split(), ("greek", "f"): "α η ια".split(), ("greek", "m"): "ας ης ος".split(),
}

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV4 = re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CARD = re.compile(r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])|(?<![0-9A-Za-z+.,/_-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z_])")
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PERSON = re.compile(rf"(?<![\w])({_NAME})(\.?[ ])(?=(?:(?:{'|'.join(PARTICLES)})[ ])*({_NAME}))")
WORD = re.compile(rf"(?<![\w]){_NAME}")
GENDER = {n: k for k, names in GIVEN.items() for n in names}
_TITLES = frozenset(TITLES)


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    canonical: str


def script_of(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def gender_of(name: str) -> tuple[str, str] | None:
    """(script, gender) of a given name: of the lists, or by the ending of a generated one."""
    if name in GENDER:
        return GENDER[name]
    fits = [(len(e), k) for k, endings in ENDINGS.items() if k[0] == script_of(name) for e in endings if name.endswith(e)]
    return max(fits)[1] if fits else None


def _titled(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and not word.isupper()


def find_entities(text: str) -> list[Entity]:
    """Entities in order, none overlapping; where patterns overlap, the first in the list of kinds has it."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", *m.span(), m[0].lower()) for m in EMAIL.finditer(text)]
    if any(c in text for c in "0123456789"):
        for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("card", CARD), ("ip", IPV4), ("phone", PHONE)):
            for m in pattern.finditer(text):
                plain = m[0] if kind == "ip" else "".join(c for c in m[0] if c.isalnum())
                if kind == "iban" and not _iban_valid(plain):
                    continue
                found.append(Entity(kind, *m.span(), plain))
    family = set()
    for m in PERSON.finditer(text):
        first, last = m[1], m[3]
        if not _titled(last) or (m[2] != " " and first not in _TITLES):
            continue
        if first in GENDER and script_of(first) == script_of(last) and last not in _TITLES:
            found.append(Entity("given", *m.span(1), first))
            family.add(last)
        elif first in _TITLES and last not in GENDER:
            family.add(last)
    if family:
        found += [Entity("family", *m.span(), m[0].lower()) for m in WORD.finditer(text) if m[0] in family]
    order = {k: i for i, k in enumerate(("email", "iban", "ssn", "card", "ip", "phone", "given", "family"))}
    taken, best = bytearray(len(text)), []
    for e in sorted(found, key=lambda e: (order[e.kind], e.start)):
        if taken.find(1, e.start, e.end) < 0:
            taken[e.start : e.end] = b"\1" * (e.end - e.start)
            best.append(e)
    return sorted(best, key=lambda e: e.start)


def _iban_valid(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


class Keyed:
    def __init__(self, key: bytes):
        self.key = key

    def number(self, *parts) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256)[:16], "big")

    def _halves(self, values: list[int], sizes: list[int]) -> list[list[int]]:
        """[value, size] of the mixed-radix number of each half."""
        half, out = (len(sizes) + 1) // 2, []
        for digits, radix in ((values[:half], sizes[:half]), (values[half:], sizes[half:])):
            n, m = 0, 1
            for d, r in zip(digits, radix, strict=True):
                n, m = n * r + d, m * r
            out.append([n, m])
        return out

    def _digits(self, both: list[list[int]], sizes: list[int]) -> list[int]:
        half, out = (len(sizes) + 1) // 2, []
        for (n, _), radix in zip(both, (sizes[:half], sizes[half:]), strict=True):
            digits = []
            for r in reversed(radix):
                n, d = divmod(n, r)
                digits.append(d)
            out += digits[::-1]
        return out

    def _rounds(self, both: list[list[int]], sizes: list[int], tweak: tuple, back: bool = False) -> None:
        for k in reversed(range(8)) if back else range(8):
            here, there = both[k % 2], both[1 - k % 2]
            step = self.number("round", k, there[0], *sizes, *tweak)
            here[0] = (here[0] - step if back else here[0] + step) % here[1]

    def permute(self, values: list[int], sizes: list[int], *tweak) -> list[int]:
        """A permutation of the mixed-radix numbers of these sizes."""
        both = self._halves(values, sizes)
        self._rounds(both, sizes, tweak)
        return self._digits(both, sizes)

    def cycle(self, values: list[int], sizes: list[int], *tweak) -> list[int]:
        """The next number in a keyed cycle through all of them: a permutation that leaves none in its place."""
        both = self._halves(values, sizes)
        self._rounds(both, sizes, tweak)
        n = (both[0][0] * both[1][1] + both[1][0] + 1) % (both[0][1] * both[1][1])
        both[0][0], both[1][0] = divmod(n, both[1][1])
        self._rounds(both, sizes, tweak, back=True)
        return self._digits(both, sizes)

    def _move(self, values: list[int], sizes: list[int], attempt: int, *tweak) -> list[int]:
        return self.cycle(values, sizes, *tweak) if attempt < 0 else self.permute(values, sizes, *tweak, attempt)

    def chars(self, text: str, *tweak, attempt: int = 0, leading: bool = True) -> str:
        """Each ASCII letter by a letter, each digit by a digit (with leading, a first one stays zero or not), the rest
        as it is."""
        at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        classes = alphabets(text, leading)
        got = self._move([c.index(text[i]) for i, c in zip(at, classes, strict=True)], [len(c) for c in classes], attempt, *tweak)
        out = list(text)
        for i, c, d in zip(at, classes, got, strict=True):
            out[i] = c[d]
        return "".join(out)

    def domain(self, domain: str) -> str:
        """An address's domain by another: the same for all addresses of it, different ones staying different."""
        labels = domain.split(".")
        kept = 2 if re.fullmatch(r".*\bexample\.(com|org|net)", domain) else 1
        return ".".join([*(self.chars(x, "label") for x in labels[:-kept]), *labels[-kept:]])

    def format_class(self, kind: str, canonical: str) -> tuple[str, str, float]:
        """(class of the entity, class of its surrogates, size of the class; infinite where names are generated)."""
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            return f"{shape(local, False)}@{domain}", f"{shape(local, False)}@{self.domain(domain)}", room(local, False)
        if kind in ("given", "family"):
            own = f"{script_of(canonical)}"
            return own, own, math.inf
        if kind == "ip":
            own = ".".join("x" * len(o) for o in canonical.split("."))
            return own, own, float(math.prod(OCTETS[len(o)][1] for o in canonical.split(".")))
        if kind == "phone":
            keep = 1 if len(canonical) > 10 else 0
            own = canonical[:keep] + shape(canonical[keep:])
            return own, own, room(canonical[keep:])
        if kind == "card":
            valid = _luhn(canonical[:-1]) == int(canonical[-1])
            own = f"{canonical[0]}{shape(canonical[1:-1])}{'L' if valid else shape(canonical[-1])}"
            return own, own, room(canonical[1:-1]) if valid else room(canonical[1:])
        if kind == "iban":
            return canonical[:2] + shape(canonical[4:]), canonical[:2] + shape(canonical[4:]), room(canonical[4:])
        return shape(canonical), shape(canonical), room(canonical)

    def surrogate(self, kind: str, canonical: str, attempt: int = 0) -> str:
        """The canonical surrogate of a canonical entity; attempt -1 is that of a class which is well filled."""
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            return f"{self.chars(local, 'local', domain, attempt=attempt, leading=False)}@{self.domain(domain)}"
        if kind == "phone":
            keep = 1 if len(canonical) > 10 else 0
            return canonical[:keep] + self.chars(canonical[keep:], "phone", canonical[:keep], attempt=attempt)
        if kind == "card":
            if _luhn(canonical[:-1]) == int(canonical[-1]):
                body = canonical[0] + self.chars(canonical[1:-1], "card", canonical[0], attempt=attempt)
                return body + str(_luhn(body))
            return canonical[0] + self.chars(canonical[1:], "number", canonical[0], attempt=attempt)
        if kind == "iban":
            body = self.chars(canonical[4:], "iban", canonical[:2], attempt=attempt)
            rest = int("".join(str(int(c, 36)) for c in f"{body}{canonical[:2]}00")) % 97
            return f"{canonical[:2]}{98 - rest:02d}{body}"
        if kind == "ip":
            ranges = [OCTETS[len(o)] for o in canonical.split(".")]
            got = self._move([int(o) - r[0] for o, r in zip(canonical.split("."), ranges, strict=True)], [r[1] for r in ranges], attempt, "ip")
            return ".".join(str(r[0] + g) for r, g in zip(ranges, got, strict=True))
        if kind == "given":
            script, gender = GENDER[canonical]
            order = sorted(GIVEN[script, gender], key=lambda n: self.number("given", n))  # a cycle through all: never the name itself
            if attempt == 0:
                return order[(order.index(canonical) + 1) % len(order)]
            n = self.number("given", canonical, attempt)
            n, k = divmod(n, len(ENDINGS[script, gender]))
            stem = self._syllables(n, script, 2 + attempt // 2)
            return (stem.rstrip("aeoаеоαεο") + ENDINGS[script, gender][k]).capitalize()
        if kind == "family":
            script, n = script_of(canonical), self.number("family", canonical, attempt)
            return self._syllables(n >> 1, script, 3 + n % 2 + attempt // 2) + "n" * (script == "latin")
        return self.chars(canonical, kind, attempt=attempt)

    @staticmethod
    def _syllables(n: int, script: str, count: int) -> str:
        """A name of so many syllables: longer ones after some draws, so that there is always one that is free."""
        out = ""
        for _ in range(count):
            n, k = divmod(n, len(SYLLABLES[script]))
            out += SYLLABLES[script][k]
        return out


#: First value and number of values of an octet, by its digits.
OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def alphabets(text: str, leading: bool = True) -> list[str]:
    """The alphabet of each ASCII letter or digit of a text."""
    out = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text if c.isascii() and c.isalnum()]
    first = next((c for c in text if c.isascii() and c.isalnum()), "")
    if leading and first.isdigit():
        out[0] = "0" if first == "0" else "123456789"
    return out


def shape(text: str, leading: bool = True) -> str:
    """The format of a text: a mark for the alphabet in place of each letter or digit."""
    marks = iter({"0": "0", "123456789": "1", "0123456789": "9"}.get(a, a[0]) for a in alphabets(text, leading))
    return "".join(next(marks) if c.isascii() and c.isalnum() else c for c in text)


def room(text: str, leading: bool = True) -> float:
    """How many texts have the same format."""
    return float(math.prod(len(a) for a in alphabets(text, leading)))


def render(original: str, kind: str, surrogate: str) -> str:
    """A canonical surrogate in the form of the original: separators, case."""
    if kind == "given":
        return surrogate
    if kind == "family":
        return surrogate.upper() if original.isupper() else surrogate.capitalize()
    if kind == "ip":
        return surrogate
    if kind == "email":
        return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=True)) if len(original) == len(surrogate) else surrogate
    fresh = iter(surrogate)
    return "".join(next(fresh) if c.isalnum() else c for c in original)


@functools.lru_cache(maxsize=1 << 16)
def _surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    return Keyed(key).surrogate(kind, canonical, attempt)


ENTITIES = "kind string, canonical string, own string, target string, room double"


def _collect(key: bytes):
    """Distinct entities of each batch with their classes."""

    def run(batches):
        keyed, names = Keyed(key), [f.split()[0] for f in ENTITIES.split(", ")]
        for batch in batches:
            texts = batch.column(0)
            seen = sorted({(e.kind, e.canonical) for i in range(batch.num_rows) for e in find_entities(texts[i].as_py() or "")})
            rows = [(*e, *keyed.format_class(*e)) for e in seen]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 4 + [pa.float64()], strict=True)], names)

    return run


def _draw(key: bytes):
    def run(batches):
        for batch in batches:
            kinds, names, attempts = (c.to_pylist() for c in batch.columns)
            got = [_surrogate(key, k, c, a) for k, c, a in zip(kinds, names, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], ["kind", "canonical", "attempt", "surrogate"])

    return run


def crowded_classes(entities: DataFrame) -> DataFrame:
    """(kind, own): the classes whose surrogates share their class with so many entities, of their own and of the
    corpus, that these fill more than half of it."""
    sizes = entities.groupBy("kind", "own").agg(F.count("*").alias("n"), F.first("target").alias("target"), F.first("room").alias("room"))
    there = sizes.select("kind", F.col("own").alias("target"), F.col("n").alias("met"))
    return sizes.join(there, ["kind", "target"], "left").where((F.col("n") + F.coalesce("met", F.lit(0))) * 2 > F.col("room")).select("kind", "own")


def attempts_needed(docs: DataFrame, key: bytes, rounds: int) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first surrogate is taken: by another entity's surrogate
    (the smaller canonical form has it) or as an entity of the corpus. Drawn again until none is left; a check that
    finds some after `rounds` draws raises. Entities of crowded classes have attempt -1: their permutation keeps them
    apart from each other, and the check is not for them."""
    drawing = "kind string, canonical string, attempt int, surrogate string"
    every = saved(docs.select("text").mapInArrow(_collect(key), ENTITIES).distinct())
    crowded = crowded_classes(every).withColumn("crowded", F.lit(-1))
    first = every.join(crowded, ["kind", "own"], "left").select("kind", "canonical", F.coalesce("crowded", F.lit(0)).alias("attempt"))
    drawn = saved(first.mapInArrow(_draw(key), drawing))
    for _ in range(rounds + 1):
        as_new = drawn.select("kind", F.col("surrogate").alias("value"), F.col("canonical").alias("of"))
        as_old = drawn.select("kind", F.col("canonical").alias("value"), F.lit(None).cast("string").alias("of"))
        met = as_new.unionByName(as_old).groupBy("kind", "value").agg(F.min("of").alias("first"), F.count("of").alias("new"), F.count(F.when(F.col("of").isNull(), 1)).alias("old")).where("new > 1 OR (new > 0 AND old > 0)")
        taken = drawn.join(met.withColumnRenamed("value", "surrogate"), ["kind", "surrogate"], "left")
        again = (F.col("attempt") >= 0) & ((F.col("old") > 0) | (F.col("first") != F.col("canonical")))
        taken = saved(taken.select("kind", "canonical", "attempt", "surrogate", F.coalesce(again, F.lit(False)).alias("again")))
        if taken.where("again").isEmpty():
            return drawn.where("attempt <> 0").select("kind", "canonical", "attempt")
        redrawn = taken.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_draw(key), drawing)
        drawn = saved(taken.where("NOT again").drop("again").unionByName(redrawn))
    raise RuntimeError(f"surrogates still collide after {rounds} draws")


def replace_entities(text: str, key: bytes, attempts: dict) -> tuple[str, list[Entity]]:
    found = find_entities(text)
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], render(text[e.start : e.end], e.kind, _surrogate(key, e.kind, e.canonical, attempts.get((e.kind, e.canonical), 0)))]
        at = e.end
    return "".join([*out, text[at:]]), found


def _rewrite(key: bytes, shared):
    def run(batches):
        common = shared.value if shared is not None else {}
        for batch in batches:
            rows = []
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                attempts = {(a["kind"], a["canonical"]): a["attempt"] for a in own[i] or []} if own is not None else common
                new, found = replace_entities(text, key, attempts) if text else (text, [])
                rows.append((doc_id, new, len(found), ",".join(f"{e.kind}:{e.start}:{e.end}" for e in found)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["doc_id", "text", "n_entities", "entities"])

    return run


def _entities(batches):
    for batch in batches:
        texts = batch.column(1)
        rows = [(rid, e.kind, e.canonical) for i, rid in enumerate(batch.column(0).to_pylist()) for e in find_entities(texts[i].as_py() or "")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["rid", "kind", "canonical"])


def pseudonymize(docs: DataFrame, key: str, *, rounds: int = 64, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, text, n_entities, entities: each row's text with its entities replaced, and their kinds and spans in
    the original text (code points, end exclusive).

    A null text stays null and an empty one empty, with no entities. Repeated rows and null ids give a row each.
    Whole texts are read and given back; other columns are not read. An empty table gives no rows. The same key
    gives the same surrogates for the same corpus. Persons are known by a given name of the lists or a title before a
    family name, which then counts throughout its text.

    The few entities that were drawn again are broadcast if at most broadcast_rows; else joined to their rows.
    """
    secret = hashlib.sha256(key.encode()).digest()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = saved(attempts_needed(rows, secret, rounds))
    schema = "doc_id long, text string, n_entities long, entities string"
    if again.count() <= broadcast_rows:
        held = {(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()}
        return rows.mapInArrow(_rewrite(secret, docs.sparkSession.sparkContext.broadcast(held)), schema)
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    own = numbered.select("rid", "text").mapInArrow(_entities, "rid long, kind string, canonical string").distinct().join(again, ["kind", "canonical"])
    lists = own.groupBy("rid").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("own"))
    return numbered.join(lists, "rid", "left").select("doc_id", "text", "own").mapInArrow(_rewrite(secret, None), schema)
