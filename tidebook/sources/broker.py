"""Clients of a broker's REST interface; the transport is injected, so nothing here opens a connection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlencode

from tidebook.config import Secret
from tidebook.sources.vendors import translate_status

Transport = Callable[[str, str, dict[str, str], dict[str, str]], tuple[int, Any]]
#: Paths that a read-only client may call.
READ_PATHS = ("/quote", "/historical")


def checksum(api_key: str, request_token: str, secret: Secret) -> str:
    return hashlib.sha256(f"{api_key}{request_token}{secret.reveal()}".encode()).hexdigest()


def login_url(base: str, api_key: str) -> str:
    return f"{base}?{urlencode({'v': 3, 'api_key': api_key})}"


def order_params(symbol: str, side: str, quantity: float, order_type: str = "market", limit_price: float | None = None) -> dict[str, str]:
    """Form fields of an order; the quantity is a whole number, and none is refused."""
    whole = round(quantity)
    if whole <= 0:
        raise ValueError(f"an order for {quantity} of {symbol} rounds to nothing")
    if order_type == "limit" and not (limit_price and limit_price > 0):
        raise ValueError("a limit order needs a positive limit_price")
    fields = {"tradingsymbol": symbol, "transaction_type": side.upper(), "quantity": str(whole), "order_type": order_type.upper()}
    if order_type == "limit":
        fields["price"] = f"{limit_price:.2f}"
    return fields


@dataclass
class ReadClient:
    """Calls whitelisted paths and unwraps envelopes: a payload of its own, or status SUCCESS / FAILURE around it."""

    transport: Transport
    base: str
    token: Secret
    paths: tuple[str, ...] = READ_PATHS

    def call(self, path: str, **query: str) -> Any:
        if not path.startswith(self.paths):
            raise PermissionError(f"{path} is not a read path")
        status, body = self.transport("GET", self.base + path, {"Authorization": f"Bearer {self.token.reveal()}"}, query)
        if (kind := translate_status(status)) is not None:
            raise kind(f"{path} answered {status}")
        if isinstance(body, dict) and "status" in body:
            if str(body["status"]).upper() == "FAILURE":
                raise RuntimeError(str(body.get("message", "failure without a message")))
            return body.get("payload", body.get("data"))
        return body
