"""Named translation services behind one registry, as providers for :mod:`lexloom.operators.translate`.

Each is a request format of :class:`~lexloom.operators.translate.Http`; keys, models and addresses are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from lexloom.functions.text import packed
from lexloom.operators.translate import Dictionary, Engine, Http, Lanes, Offline, Pace, Provider, RoundRobin


class OneByOne:
    """A service that takes one text a request."""

    def __init__(self, http: Http):
        self.http = http

    def translate(self, texts: Sequence[str]) -> list[str]:
        return [self.http.translate([t])[0] for t in texts]


class Chunked:
    """Cuts texts beyond a service's limit at line ends and puts the answers together again."""

    def __init__(self, inner: Provider, limit: int):
        self.inner, self.limit = inner, limit

    def translate(self, texts: Sequence[str]) -> list[str]:
        parts = [packed(t, self.limit) for t in texts]
        told = iter(self.inner.translate([p for own in parts for p in own]))
        return ["\n".join(next(told) for _ in own) for own in parts]


class Sequential:
    """Asks for texts together, and one by one where that fails or the answers don't fit."""

    def __init__(self, inner: Provider):
        self.inner = inner

    def translate(self, texts: Sequence[str]) -> list[str]:
        try:
            told = list(self.inner.translate(texts))
            if len(told) == len(texts):
                return told
        except Exception:
            if len(texts) == 1:
                raise
        return [self.inner.translate([t])[0] for t in texts]


class Alone:
    """Sends texts beyond ``limit`` characters by themselves, the others together."""

    def __init__(self, inner: Provider, limit: int):
        self.inner, self.limit = inner, limit

    def translate(self, texts: Sequence[str]) -> list[str]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.limit]
        out = dict(zip(short, self.inner.translate([texts[i] for i in short]))) if short else {}
        return [out[i] if i in out else self.inner.translate([t])[0] for i, t in enumerate(texts)]


def deepl(source: str, target: str, key: str = "", model: str = "", url: str = "", pace: Pace | None = None) -> Provider:
    host = url or ("https://api-free.deepl.com" if key.endswith(":fx") else "https://api.deepl.com")
    encode = lambda texts: {"text": texts, "source_lang": source.upper(), "target_lang": target.upper()}
    decode = lambda answer: [t["text"] for t in answer["translations"]]
    return Chunked(Sequential(Http(f"{host}/v2/translate", encode, decode, {"Authorization": f"DeepL-Auth-Key {key}"}, per_request=50, pace=pace)), 50_000)


def libre(source: str, target: str, key: str = "", model: str = "", url: str = "", pace: Pace | None = None) -> Provider:
    encode = lambda texts: {"q": texts, "source": source, "target": target, "format": "text"} | ({"api_key": key} if key else {})
    return Alone(Http(f"{url or 'http://localhost:5000'}/translate", encode, lambda answer: answer["translatedText"], per_request=50, pace=pace), 5_000)


def _question(source: str, target: str, text: str) -> str:
    return f"Translate from {source} to {target}. Keep code, addresses and placeholders. Answer with the translation only.\n\n{text}"


def chat(source: str, target: str, key: str = "", model: str = "", url: str = "", pace: Pace | None = None) -> Provider:
    """Services with the chat completions format."""
    encode = lambda texts: {"model": model, "temperature": 0.3, "messages": [{"role": "user", "content": _question(source, target, texts[0])}]}
    decode = lambda answer: [answer["choices"][0]["message"]["content"].strip()]
    return Chunked(OneByOne(Http(f"{url.rstrip('/')}/chat/completions", encode, decode, {"Authorization": f"Bearer {key}"}, per_request=1, pace=pace, timeout=120)), 8_000)


def ollama(source: str, target: str, key: str = "", model: str = "", url: str = "", pace: Pace | None = None) -> Provider:
    encode = lambda texts: {"model": model, "prompt": _question(source, target, texts[0]), "stream": False}
    decode = lambda answer: [answer["response"].strip()]
    return OneByOne(Http(f"{url or 'http://localhost:11434'}/api/generate", encode, decode, per_request=1, pace=pace, timeout=120))


ENGINES: dict[str, Callable[..., Provider]] = {
    "deepl": deepl, "libre": libre, "chat": chat, "ollama": ollama,
    "identity": lambda *_, **__: Offline(str), "upper": lambda *_, **__: Offline(str.upper), "dictionary": lambda *_, words=None, **__: Dictionary(words or {}),
}


#: Requests a second that services are asked at most, all tasks together.
RATES = {"deepl": 2.0, "chat": 2.0}


def _named(names: str, keys: str, models: str, urls: str):
    """(engine, its key, model and address) of comma lists in the same order."""
    lists = [[x.strip() for x in text.split(",")] for text in (keys, models, urls)]
    for k, name in enumerate(n.strip() for n in names.split(",")):
        if name not in ENGINES:
            raise ValueError(f"unknown engine {name!r}; known are {', '.join(sorted(ENGINES))}")
        yield name, dict(zip(("key", "model", "url"), (one[k] if k < len(one) else "" for one in lists)))


def provider(names: str, source: str, target: str, keys: str = "", models: str = "", urls: str = "") -> Provider:
    """One engine, or several by a comma list with their keys, models and addresses in the same order; for one task."""
    made = [ENGINES[name](source, target, **how, pace=Pace(1 / RATES[name]) if name in RATES else None) for name, how in _named(names, keys, models, urls)]
    return made[0] if len(made) == 1 else RoundRobin(made)


def lanes(names: str, source: str, target: str, keys: str = "", models: str = "", urls: str = "", each: int = 1, rates: dict[str, float] | None = None) -> Lanes:
    """The same engines for a cluster: ``each`` lanes of every engine, which share its rate."""
    known = RATES | (rates or {})
    maker = lambda name, how: lambda pace: ENGINES[name](source, target, **how, pace=pace)
    return Lanes([Engine(maker(name, how), each, known.get(name)) for name, how in _named(names, keys, models, urls)])
