"""The request templates of validators: ``{{ VARIABLE | filter: argument | .. }}``."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import secrets
import string
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

_TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.DOTALL)
_PART = re.compile(r"""("[^"]*"|'[^']*'|[^|"']+)+""")
_ARG = re.compile(r"""\s*("[^"]*"|'[^']*'|[^,\s]+)\s*,?""")


class TemplateError(ValueError):
    """A template names an unknown filter or is malformed."""


def _b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def _b64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _keyed(digest: str) -> Callable:
    return lambda text, key: _b64(hmac.new(str(key).encode(), str(text).encode(), digest).digest())


def _random(text: str, length: str | int | None = None) -> str:
    size = int(length if length is not None else text if str(text).isdigit() else 32)
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(size))


def _percent(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "".join(f"%{b:02X}" for b in c.encode()) for c in str(text))


FILTERS: dict[str, Callable] = {
    "append": lambda x, y: f"{x}{y}",
    "prepend": lambda x, y: f"{y}{x}",
    "split": lambda x, sep: str(x).split(sep) if sep else list(str(x)),
    "first": lambda x: x[0] if len(x) else "",
    "last": lambda x: x[-1] if len(x) else "",
    "upcase": lambda x: str(x).upper(),
    "downcase": lambda x: str(x).lower(),
    "strip": lambda x: str(x).strip(),
    "size": lambda x: str(len(x)),
    "replace": lambda x, a, b="": str(x).replace(a, b),
    "default": lambda x, y: x or y,
    "b64enc": lambda x: _b64(str(x).encode()),
    "b64url_enc": lambda x: _b64url(str(x).encode()),
    "sha256": lambda x: hashlib.sha256(str(x).encode()).hexdigest(),
    "hmac_sha256": _keyed("sha256"),
    "hmac_sha384": _keyed("sha384"),
    "random_string": _random,
    "url_encode": _percent,
    "json_escape": lambda x: json.dumps(str(x), ensure_ascii=False),
    "jwt_header": lambda x: _b64url(json.dumps({"typ": "JWT", "alg": str(x)}, separators=(",", ":")).encode()),
    "unix_timestamp": lambda _=None: str(int(time.time())),
    "iso_timestamp": lambda _=None: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
    "uuid": lambda _=None: str(uuid.uuid4()),
}


def _value(token: str, variables: Mapping[str, str]):
    token = token.strip()
    if token[:1] in "\"'" and token[-1:] == token[:1] and len(token) > 1:
        return token[1:-1]
    return token if re.fullmatch(r"-?\d+(\.\d+)?", token) else variables.get(token, "")


def render(template: str, variables: Mapping[str, str]) -> str:
    """Every tag replaced by its value; unknown variables are empty, unknown filters an error."""

    def tag(m: re.Match) -> str:
        parts = [p[0] for p in _PART.finditer(m[1])]
        value = _value(parts[0], variables) if parts else ""
        for part in parts[1:]:
            name, _, rest = part.strip().partition(":")
            if name.strip() not in FILTERS:
                raise TemplateError(f"unknown filter {name.strip()!r}")
            args = [_value(a[1], variables) for a in _ARG.finditer(rest)]
            try:
                value = FILTERS[name.strip()](value, *args)
            except TypeError as error:
                raise TemplateError(f"{name.strip()}: {error}") from error
        return "".join(value) if isinstance(value, list) else str(value)

    return _TAG.sub(tag, template)
