"""Type-shaped fake values, computed from a hash of (seed, type, value).

No state and no call order: two tasks, runs or clusters give the same fake.
A generator is a function from the SQL text of an md5 hex string to SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from spanveil.functions.arrays import let, literal

Generator = Callable[[str], str]
SEED = 42
REDACTED = "<REDACTED>"

FIRST_NAMES = """Aarav Aditi Akash Ananya Anil Anita Arjun Asha Bhavna Chetan Deepa Dev Divya
Esha Farhan Gauri Girish Harini Isha Jaya Karan Kavya Kiran Lakshmi Madhav Meera Mohan Nandini
Neha Nikhil Omkar Pooja Pranav Priya Rahul Rekha Rohan Sanjay Sarita Shreya Sunil Tanvi Uma Varun
Vikram Yash Zoya""".split()
LAST_NAMES = """Agarwal Bose Chandra Chopra Das Desai Dutta Gandhi Ghosh Gupta Iyer Jain Joshi
Kapoor Khan Kulkarni Kumar Malhotra Mehta Menon Mishra Mukherjee Nair Naidu Pandey Patel Pillai
Rao Reddy Roy Saxena Sen Shah Sharma Shetty Singh Sinha Thakur Trivedi Varma Verma Yadav""".split()
STREETS = """Lotus Marg;Temple Road;Lake View Road;Station Road;Garden Lane;Nehru Street;Hill Road;
Market Street;River Side;Palm Avenue;Mango Lane;College Road""".replace("\n", "").split(";")
PLACES = """Nagpur, Maharashtra;Mysuru, Karnataka;Kochi, Kerala;Jaipur, Rajasthan;Surat, Gujarat;
Indore, Madhya Pradesh;Patna, Bihar;Guwahati, Assam;Ranchi, Jharkhand;Salem, Tamil Nadu;
Lucknow, Uttar Pradesh;Shimla, Himachal Pradesh""".replace("\n", "").split(";")
MAIL_DOMAINS = ("example.com", "example.org", "example.net")

# Dates of birth: aged 18 to 75 on a fixed day, so that results do not change with time.
BIRTH_FIRST, BIRTH_LAST = date(1950, 1, 2), date(2008, 1, 1)
BIRTH_DAYS = (BIRTH_LAST - BIRTH_FIRST).days + 1


def number(h: str, i: int) -> str:
    """The i-th (0-3) group of seven hex digits as an integer."""
    return f"CAST(conv(substring({h}, {1 + 8 * i}, 7), 16, 10) AS BIGINT)"


def pick(h: str, i: int, words) -> str:
    # One literal to split is cheaper to plan than an array of many.
    listed = f"split({literal(';'.join(words))}, ';')"
    return f"{listed}[CAST({number(h, i)} % {len(words)} AS INT)]"


def digits(h: str, i: int, width: int, first: int = 0) -> str:
    """A number from ``first`` to 10^width - 1 with leading zeros."""
    return (f"lpad(CAST({first} + {number(h, i)} % {10 ** width - first} AS STRING), "
            f"{width}, '0')")


def _person(h: str) -> str:
    return f"concat({pick(h, 0, FIRST_NAMES)}, ' ', {pick(h, 1, LAST_NAMES)})"


def _card(h: str) -> str:
    body = f"concat('4', {digits(h, 0, 7)}, {digits(h, 1, 7)})"
    return (f"transform(array({body}), b -> concat(b, CAST(filter(sequence(0, 9), "
            f"d -> luhn_check(concat(b, CAST(d AS STRING))))[0] AS STRING)))[0]")


GENERATORS: dict[str, Generator] = {
    "PERSON": _person,
    "ORG": lambda h: f"concat({_person(h)}, ' Technologies Private Limited')",
    "EMAIL": lambda h: (f"concat(lower({pick(h, 0, FIRST_NAMES)}), '.', "
                        f"lower({pick(h, 1, LAST_NAMES)}), {digits(h, 2, 4)}, '@', "
                        f"{pick(h, 3, MAIL_DOMAINS)})"),
    "PHONE": lambda h: (f"concat('+91 ', CAST(6 + {number(h, 0)} % 4 AS STRING), "
                        f"{digits(h, 1, 5)}, {digits(h, 2, 4)})"),
    "ADDRESS": lambda h: (f"concat(CAST(1 + {number(h, 0)} % 999 AS STRING), ' ', "
                          f"{pick(h, 1, STREETS)}, ', ', {pick(h, 2, PLACES)}, ', ', "
                          f"{digits(h, 3, 6, 100000)}, ', India')"),
    "DOB": lambda h: (f"date_format(date_add(DATE'{BIRTH_FIRST}', "
                      f"CAST({number(h, 0)} % {BIRTH_DAYS} AS INT)), 'dd/MM/yyyy')"),
    "IP_ADDRESS": lambda h: (f"concat_ws('.', CAST(1 + {number(h, 0)} % 223 AS STRING), "
                             f"CAST({number(h, 1)} % 256 AS STRING), "
                             f"CAST({number(h, 2)} % 256 AS STRING), "
                             f"CAST(1 + {number(h, 3)} % 254 AS STRING))"),
    "CREDIT_CARD": _card,
    "SSN": lambda h: f"concat_ws('-', {digits(h, 0, 3, 1)}, {digits(h, 1, 2, 1)}, {digits(h, 2, 4, 1)})",
}


def constant_masks(types) -> dict[str, Generator]:
    """Generators that give ``<TYPE>`` for every value."""
    return {t: (lambda h, t=t: literal(f"<{t}>")) for t in types}


def fake(entity_type: str, value: str, seed: int = SEED,
         generators: dict[str, Generator] | None = None) -> str:
    """SQL for the fake of a value; types without a generator give ``<REDACTED>``.

    ``generators`` extends or overrides the table by type.
    """
    cases = " ".join(f"WHEN {literal(t)} THEN {make('h')}"
                     for t, make in {**GENERATORS, **(generators or {})}.items())
    key = f"md5(concat_ws('|', '{int(seed)}', {entity_type}, {value}))"
    return let("h", key, f"CASE {entity_type} {cases} ELSE {literal(REDACTED)} END")
