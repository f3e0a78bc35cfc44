"""What can go wrong with an embedding or language service, in terms that a user can act on."""

from __future__ import annotations


class ServiceError(RuntimeError):
    """The service could not complete a request."""

    advice = "Try again."


class KeyRejected(ServiceError):
    advice = "Check the key."


class QuotaExhausted(ServiceError):
    advice = "Check the account's quota and billing."


class RateLimited(ServiceError):
    advice = "Wait a moment, or use a key with higher limits."


class Unreachable(ServiceError):
    advice = "Check the network."


_QUOTA = ("quota", "billing", "credit")
_NETWORK = ("timeout", "timed out", "connection", "network")


def classified(e: BaseException) -> ServiceError:
    """The kind of a failed request, from its status code, class name and message."""
    status, name, said = getattr(e, "status_code", None), type(e).__name__.lower(), str(e).lower()
    if isinstance(e, ServiceError):
        return e
    if status == 401 or "authentication" in name or "invalid api key" in said:
        kind = KeyRejected
    elif status == 402 or status == 429 and any(x in said for x in _QUOTA):
        kind = QuotaExhausted
    elif status == 429:
        kind = RateLimited
    elif isinstance(e, TimeoutError) or any(x in name for x in ("apiconnection", "apitimeout", "connecterror", "readtimeout")) or any(x in said for x in _NETWORK):
        kind = Unreachable
    else:
        kind = ServiceError
    return kind(f"{type(e).__name__}: {e}. {kind.advice}")
