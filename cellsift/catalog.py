"""Detector catalogues: named regular expressions, kept as data on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

try:
    from re import _parser as _sre
except ImportError:  # Python 3.10
    import sre_parse as _sre


@dataclass(frozen=True)
class Detector:
    """One named pattern in Java syntax, without flags.

    ``literals``: lower-case ASCII strings, at least one of which is inside every match.
    ``prechecks``: cheaper patterns, each of which is found wherever a match is; detectors share their evaluation.
    Both only skip work; a detector without them gives the same result.
    """

    name: str
    pattern: str
    literals: tuple[str, ...] = ()
    prechecks: tuple[str, ...] = ()


FOUR_DIGITS = r"\d{4}"


def _token(name: str, pattern: str, *literals: str) -> Detector:
    return Detector(name, pattern, literals)


# Names and token shapes of the built-in detectors, in their customary order.
# Every pattern is matched without regard to case.
_AWS_PREFIXES = ("a3t[a-z0-9]", "akia", "agpa", "aroa", "aipa", "anpa", "anva", "asia")
_AWS_KEY = rf"({'|'.join(_AWS_PREFIXES)})[a-z0-9]{{16}}"
_AWS_LITERALS = tuple(p[:4].removesuffix("[") for p in _AWS_PREFIXES)
_MAILCHIMP = r"[0-9a-f]{32}-us[0-9]{1,2}"
DEFAULT_CATALOG: tuple[Detector, ...] = (
    Detector("Email", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", ("@",)),
    Detector("Phone Number", r"^\(\+\d{1,2}\s\)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}$", ("(+",)),
    Detector("Aadhar", r"\b\d{4}[-.]?\d{4}[-.]?\d{4}\b", (), (FOUR_DIGITS,)),
    Detector(
        "PAN",
        r"\b(?:panNumber\s*:\s*|pan\s*:\s*|panNo\s*=\s*|<)?\s*[a-z]{5}[0-9]{4}[a-z]\s*>?\b",
        (),
        (FOUR_DIGITS, r"[0-9]{4}[a-z]"),
    ),
    _token("Amazon MWS Auth Token", r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "amzn.mws."),
    Detector("Amazon SNS Topic Disclosure", r"arn:aws:sns:[a-z0-9-]+:[0-9]+:[a-z0-9_-]+", ("arn:aws:sns:",)),
    Detector("AWS Access Key ID Value", _AWS_KEY, _AWS_LITERALS),
    Detector("Cloudinary Credentials Disclosure", r"cloudinary://[0-9]{15}:[0-9a-z_-]+@[0-9a-z_-]+", ("://",)),
    _token("FCM Server Key", r"aaaa[a-z0-9_-]{7}:[a-z0-9_-]{140}", "aaaa"),
    _token("Mailchimp API", _MAILCHIMP, "-us"),
    _token("Slack access token", r"xoxb-[0-9a-z-]{51}", "xoxb-"),
    _token("Slack User token disclosure", r"xoxp-[0-9a-z-]{72}", "xoxp-"),
    _token(
        "Slack Webhook",
        r"https://hooks.slack.com/services/t[0-9a-z_-]{10}/b[0-9a-z_-]{10}/[0-9a-z_-]{23}",
        "https://hooks",
    ),
    _token("SonarQube Token", r"""sonar.{0,50}["'`]?[0-9a-f]{40}["'`]?""", "sonar"),
    Detector("AWS Access Key ID", _AWS_KEY, _AWS_LITERALS),
    _token("AWS Cognito Pool ID", r":[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}", ":"),
    Detector(
        "Basic Auth Credentials",
        r"""[a-z]{3,10}://[^/\s:@]{3,20}:[^/\s:@]{3,20}@.{1,100}["'\s]""",
        ("://",),
        (r"://[^/\s:@]{3,20}:",),
    ),
    _token("Dynatrace Token", r"dt0[a-z][0-9]{2}\.[a-z0-9]{24}\.[a-z0-9]{64}", "dt0"),
    Detector(
        "Facebook Client ID",
        r"""(facebook|fb)(.{0,20})?['"][0-9]{13,17}['"]""",
        ("facebook", "fb"),
        (FOUR_DIGITS,),
    ),
    _token("Facebook Secret Key", r"""(facebook|fb)(.{0,20})?['"][0-9a-f]{32}['"]""", "facebook", "fb"),
    Detector("Google (GCP) Service-account", r'"type": "service_account"', ('": "',)),
    _token("Google API key", r"aiza[0-9a-z_-]{35}", "aiza"),
    Detector("Linkedin Client ID", r"linkedin(.{0,20})?[0-9a-z]{12}", ("linkedin",)),
    _token("Mailchimp API Key", _MAILCHIMP, "-us"),
    _token("Mailgun API Key", r"key-[0-9a-z]{32}", "key-"),
    _token(
        "Paypal Braintree Access Token", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}", "$production$"
    ),
    _token("Pictatic API Key", r"sk_live_[0-9a-z]{32}", "sk_live_"),
    _token("Sendgrid API Key", r"sg\.[a-z0-9]{22}\.[a-z0-9]{43}", "sg."),
    _token("Shopify Custom App Access Token", r"shpca_[a-f0-9]{32}", "shpca_"),
    _token("Shopify Private App Access Token", r"shppa_[a-f0-9]{32}", "shppa_"),
    _token("Shopify Shared Secret", r"shpss_[a-f0-9]{32}", "shpss_"),
    _token("Square Accesss Token", r"sq0atp-[0-9a-z_-]{22}", "sq0atp-"),
    _token("Square OAuth Secret", r"sq0csp-[0-9a-z_-]{43}", "sq0csp-"),
    _token("Twilio API Key", r"twilio(.{0,20})?sk[0-9a-f]{32}", "twilio"),
    _token("Twitter Secret", r"twitter(.{0,20})?[0-9a-z]{35,44}", "twitter"),
)

Catalog = Mapping[str, str] | Iterable[Detector] | None


def as_catalog(catalog: Catalog = None) -> list[Detector]:
    """Accept nothing (the built-in set), ``{name: python regex}``, or detectors."""
    if catalog is None:
        return list(DEFAULT_CATALOG)
    if isinstance(catalog, Mapping):
        return [Detector(name, java_pattern(rx), required_literals(rx)) for name, rx in catalog.items()]
    return list(catalog)


def load_catalog(path: str) -> list[Detector]:
    """Read a ``name: regex`` file from the driver's disk, JSON or (where a parser is installed) YAML."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        loaded = json.loads(body)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a catalogue that is not JSON needs a YAML parser") from e
        loaded = yaml.safe_load(body)
    return as_catalog(loaded)


def catalog_from_table(df: DataFrame, name: str = "pattern_name", pattern: str = "pattern") -> list[Detector]:
    """Detectors kept in a two-column table. They come to the driver, as every plan is made from them there; a catalogue is
    written by people and does not grow with the data."""
    rows = df.select(name, pattern).collect()
    return as_catalog({r[0]: r[1] for r in sorted(rows)})


_TOKEN = re.compile(
    r"(?P<escape>\\.)|(?P<named>\(\?P<(?P<gname>\w+)>)|(?P<backref>\(\?P=(?P<bname>\w+)\))"
    r"|(?P<upto>\{,(?=\d+\}))|(?P<other>.)",
    re.DOTALL,
)


def java_pattern(python_pattern: str) -> str:
    """Spell a Python regex the way ``java.util.regex`` wants it (group names, ``\\Z``, ``{,n}``, brackets in sets)."""
    out: list[str] = []
    set_start = -1  # index in ``out`` right after the opening bracket of a character set
    for m in _TOKEN.finditer(python_pattern):
        text = m.group()
        if set_start >= 0:
            at_start = len(out) == set_start or (len(out) == set_start + 1 and out[-1] == "^")
            if m["escape"] or len(text) > 1:
                out.append(text if m["escape"] else re.sub(r"([\[&])", r"\\\1", text))
            elif text == "]" and not at_start:
                out.append(text)
                set_start = -1
            else:
                out.append("\\" + text if text in "[]&" else text)
        elif m["escape"]:
            out.append(r"\z" if text == r"\Z" else text)
        elif m["named"]:
            out.append(f"(?<{_group_name(m['gname'])}>")
        elif m["backref"]:
            out.append(rf"\k<{_group_name(m['bname'])}>")
        elif m["upto"]:
            out.append("{0,")
        else:
            out.append(text)
            if text == "[":
                set_start = len(out)
    return "".join(out)


def required_literals(python_pattern: str) -> tuple[str, ...]:
    """The longest ASCII literal that every match of a Python regex must hold, lower-cased; empty if none is found."""
    try:
        parsed = _sre.parse(python_pattern, re.IGNORECASE)
    except (AttributeError, re.error):
        return ()
    runs = [r for r in _literal_runs(parsed) if r.strip("0123456789. ")]
    return (max(runs, key=len),) if runs else ()


def _literal_runs(parsed) -> list[str]:
    """Literal stretches of a regex's top level that no match can do without."""
    runs, run = [], ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        runs, run = [*runs, run], ""
        if kind == "SUBPATTERN":
            runs += _literal_runs(arg[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            runs += _literal_runs(arg[-1])
    return [r for r in [*runs, run] if r]


#: A required literal is spelled out in so many ways at most, a small set of characters in so many.
_SPELLINGS, _SET = 16, 4
#: Matches of so many characters at most count as bounded.
_WIDTH = 256


#: No match of these can be told from the characters it takes alone: anchors, boundaries, look-arounds, conditions.
_CONTEXT = {"AT", "ASSERT", "ASSERT_NOT", "GROUPREF_EXISTS"}


def literal_choices(python_pattern: str) -> tuple[tuple[str, ...], int | None]:
    """Lower-cased ASCII literals of one length, one of which every match of a Python regex must hold; empty if none are found.

    Like ``required_literals``, but a set of a few characters (``word[.,]``) goes on with the literal, in each of its ways.
    Beside them the most characters a match takes, or None if there is no bound or a match depends on what is around it.
    """
    try:
        parsed = _sre.parse(python_pattern, re.IGNORECASE)
    except (AttributeError, re.error):
        return (), None
    runs = [r for r in _spelled_runs(parsed) if all(x.strip("0123456789. ") for x in r)]
    most = parsed.getwidth()[1]
    width = most if most <= _WIDTH and not _in_context(parsed) else None
    return max(runs, key=lambda r: (len(r[0]), -len(r)), default=()), width


def _in_context(parsed) -> bool:
    """Whether an operation of ``_CONTEXT`` is anywhere in a parsed regex."""
    if isinstance(parsed, (list, tuple, _sre.SubPattern)):
        return any(_in_context(x) for x in parsed)
    return str(parsed) in _CONTEXT


def _spelled_runs(parsed) -> list[tuple[str, ...]]:
    """The stretches of ``_literal_runs``, each as all its spellings."""
    runs: list[tuple[str, ...]] = []
    run: tuple[str, ...] = ("",)
    for op, arg in parsed:
        kind = str(op)
        members = [arg] if kind == "LITERAL" else [x for _, x in arg] if kind == "IN" and all(str(o) == "LITERAL" for o, _ in arg) else []
        ways = sorted({chr(x).lower() for x in members}) if all(x < 128 for x in members) else []
        if ways and len(ways) <= _SET:
            if len(run) * len(ways) > _SPELLINGS:
                runs, run = [*runs, run], ("",)
            run = tuple(r + w for r in run for w in ways)
            continue
        runs, run = [*runs, run], ("",)
        if kind == "SUBPATTERN":
            runs += _spelled_runs(arg[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            runs += _spelled_runs(arg[-1])
    return [r for r in [*runs, run] if r[0]]


def _group_name(name: str) -> str:
    return "g" + "".join(c if c.isalnum() else format(ord(c), "x") for c in name)


def group_count(pattern: str) -> int:
    """Number of capture groups of a Java pattern."""
    if "(" not in pattern:
        return 0
    bare = re.sub(r"\\Q.*?\\E|\\.", "", pattern, flags=re.DOTALL)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))
