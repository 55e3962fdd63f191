"""The recognition patterns, in Python's notation, as FIXED VALUES.

A pattern is (flags, prefix, value, tail, first): only ``value`` becomes the span,
``tail`` never consumes characters. ``regex.java`` turns them into Java's
notation with Python's meaning of the character classes. Four parts are only there for
speed: ``first`` (Java notation) is implied by the rest, what every match starts with;
``scan``, ``scan_value`` and ``scan_tail`` stand for prefix, value and tail on the JVM and
find the same matches in linear time.
"""

from typing import NamedTuple


class Pattern(NamedTuple):
    flags: str
    prefix: str
    value: str
    tail: str = ""
    first: str = ""
    scan: str = ""
    scan_value: str = ""
    scan_tail: str = ""

    @property
    def python(self) -> str:
        """The whole pattern for Python's ``re``, the value as group ``v``."""
        head = f"(?{self.flags})" if self.flags else ""
        return f"{head}{self.prefix}(?P<v>{self.value}){self.tail}"


# Parts of the JVM forms: characters of a company's words, its legal forms, words of an address.
_RUN = r"[A-Za-z0-9&.'()/\-]"
_FORMS = r"(?:Private\s+Limited|Pvt\.?\s+Ltd\.?|Limited|Ltd\.?|LLP|Inc\.?|Corporation)\b"
_PLACE = r"(?=[vtdspiVTDSPI\u0130\u0131\u017f])(?:\bVillage\b|\bTaluka\b|\bDistrict\b|\bState\b|\bPIN(?:\s*+Code)?\b|\bIndia\b)"
_SEPARATOR = r"\s*+[:\-]?+\s*+"

# One pattern per recognizer.
EMAIL = Pattern("", r"\b", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b",
                # once per run of local characters (or where the last match ended): is there an
                # @ after it? If so, from the first word boundary in the run
                scan=r"(?:\G|(?<![A-Za-z0-9._%+-]))(?=[A-Za-z0-9._%+-]++@)(?>[A-Za-z0-9._%+-]*?\b)")
PHONE = Pattern("", r"(?<!\d)",
                r"(?:\+91[\s.-]?)?(?:[6-9]\d{4}[\s.-]?\d{5}|[6-9]\d{9})", r"(?!\d)", "[+6-9]")
IP_ADDRESS = Pattern("", r"\b", r"(?:\d{1,3}\.){3}\d{1,3}", r"\b", r"\p{Nd}")
SSN = Pattern("", r"\b", r"\d{3}-\d{2}-\d{4}", r"\b", r"\p{Nd}")
CREDIT_CARD = Pattern("", r"(?<!\d)", r"(?:\d[ -]?){12,18}\d", r"(?!\d)", r"\p{Nd}")
DOB = Pattern("i", r"\b(?:date\s+of\s+birth|dob|born\s+on)\s*[:\-]?\s*",
              r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\b", "[dbDB]")
COMPANY = Pattern("", r"(?<![A-Za-z])",
                  r"(?:[A-Z][A-Za-z0-9&.'()/\-]*\s+){1,5}"
                  r"(?:Private\s+Limited|Pvt\.?\s+Ltd\.?|Limited|Ltd\.?|LLP|Inc\.?|Corporation)",
                  r"\b",
                  # What follows a word's end is the same from every start inside the word. So it is
                  # looked at once per run of word characters (or where the last match ended), and
                  # then the match starts at the first capital that may start one.
                  scan=rf"(?:\G|(?<!{_RUN}))(?={_RUN}++\s++(?:[A-Z]{_RUN}*+\s++){{0,4}}{_FORMS})"
                       rf"(?>{_RUN}*?(?<![A-Za-z])(?=[A-Z]))")
OFFICE_ADDRESS = Pattern("ims",
                         r"\b(?:Registered\s+Office|Corporate\s+Office|Branch\s+Office|"
                         r"Correspondence\s+Address|Residential\s+Address)\s*[:\-]?\s*",
                         r"[^;]{2,300}?(?:\bVillage\b|\bTaluka\b|\bDistrict\b|\bState\b|"
                         r"\bPIN(?:\s*Code)?\b|\bIndia\b)[^;]{0,180}",
                         r"(?=;|\n\s*\n|$)", "[rcbRCB]",
                         # The value starts behind all blanks; only where its word stands there at once
                         # (it needs two characters before it) it starts two characters ahead of the word.
                         scan=r"\b(?:Registered\s+Office|Corporate\s+Office|Branch\s+Office|"
                              r"Correspondence\s+Address|Residential\s+Address)"
                              rf"(?:{_SEPARATOR}|(?={_SEPARATOR}[^;]?{_PLACE})[\s:\-]*?(?=[^;]{{2}}{_PLACE}))",
                         # the tail's $ stands before every line end, so ; or a line's end must be in reach
                         scan_value=rf"[^;]{{2,300}}?{_PLACE}(?=[^;\n]{{0,180}}+(?:[;\n]|\z))[^;]{{0,180}}",
                         scan_tail=r"(?=[;\n]|\z)")
FIELD_ADDRESS = Pattern("im", r"\b(?:Village|Taluka|District|State|PIN(?:\s*Code)?)\s*[:\-]\s*",
                        r"[^\r\n;]{2,120}", "", "[vtdspVTDSP\u017f]")
COMPANY_SUFFIX = Pattern("i", "", r"(?:private\s+limited|pvt\.?\s+ltd\.?|limited|ltd\.?|llp|"
                                  r"inc\.?|corporation)", r"\s*$")
