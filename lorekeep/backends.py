"""Pluggable models: embedding, analysis, image description and chat.

A backend is any picklable callable; the executors call it in Arrow batches.
The defaults need no network, so every plan can run offline. The HTTP clients
speak the common local-model protocol and are used only when configured.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[str], "list[float] | None"]
Describer = Callable[[bytes, str], "str | None"]
Chat = Callable[[str], str]

# Window of a text that a model is shown, least window, attempts, waits.
EMBED_WINDOW = 8000
EMBED_LEAST = 250
EMBED_ATTEMPTS = 2
VISION_ATTEMPTS = 2
VISION_BACKOFF_SECONDS = 2
WARM_UP, WARM_UP_SECONDS = "Reply with the word ready.", 300
OCR_PROMPT = (
    "The picture is part of a document that people search by its words. Write down every word "
    "that can be read in it; where a drawing or a screen carries meaning, say what it shows."
)


class ContextTooLong(Exception):
    """The model cannot take a text of this length."""


@dataclass(frozen=True)
class HashingEmbedder:
    """Deterministic signed feature hashing of lower-cased words, unit length.

    A word's number is the first eight hexadecimal digits of its MD5.
    """

    dim: int

    def __call__(self, text: str) -> list[float] | None:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[float] | None]:
        """Vectors of whole texts; equal words of a batch are hashed once."""
        split = [(t or "").lower().split() for t in texts]
        words = list(dict.fromkeys(w for part in split for w in part))
        codes = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words}
        out = []
        for part in split:
            code = np.fromiter(map(codes.__getitem__, part), np.int64, len(part))
            sign = np.where(code & 0x80000000, 1.0, -1.0)
            vector = np.bincount(code % self.dim, sign, self.dim)
            norm = np.linalg.norm(vector)
            out.append(None if norm == 0 else (vector / norm).tolist())
        return out


@dataclass(frozen=True)
class HttpEmbedder:
    base_url: str
    model: str
    timeout: int = 180

    def __call__(self, text: str) -> list[float] | None:
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(
            self.base_url.rstrip("/") + "/api/embeddings",
            data=body,
            headers={"Content-Type": "application/json"},
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply).get("embedding")
        except urllib.error.HTTPError as problem:
            if problem.code == 500 and b"context length" in problem.read():
                raise ContextTooLong from problem
            return None
        except (OSError, ValueError):
            return None


def embed_text(text: str | None, embedder: Embedder, dim: int) -> list[float] | None:
    """One vector of the whole text, or None.

    A text longer than the window is embedded window by window; a window that
    is too long for the model is halved. Several vectors are averaged with
    their windows' lengths and scaled to unit length.
    """
    text = text or ""
    found: list[tuple[list[float], int]] = []
    size, start = EMBED_WINDOW, 0
    while start < len(text) or not found:
        piece = text[start : start + size]
        try:
            vector = embedder(piece)
        except ContextTooLong:
            size = min(size, len(piece)) // 2
            if size < EMBED_LEAST:
                return None
            continue
        except Exception:  # noqa: BLE001 - a failing model must not fail the job
            return None
        if vector is None or len(vector) != dim:
            return None
        found.append((list(vector), len(piece)))
        start += size
    if len(found) == 1:
        return found[0][0]
    total = np.average([v for v, _ in found], axis=0, weights=[n for _, n in found])
    norm = np.linalg.norm(total)
    return None if norm == 0 else (total / norm).tolist()


def embed_column(embedder: Embedder, dim: int, attempts: int = EMBED_ATTEMPTS):
    """A column function ``text -> array<float>``; NULL where the model failed.

    A model with a ``batch`` method is shown all texts of a batch at once.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[float] | None:
            for _ in range(attempts):
                vector = embed_text(text, embedder, dim)
                if vector is not None:
                    return vector
            return None

        together = getattr(embedder, "batch", None)
        for texts in batches:
            yield pd.Series(together(texts.tolist()) if together else [one(t) for t in texts], dtype=object)

    return embed


@dataclass(frozen=True)
class HttpChat:
    """Chat completion over HTTP; the answer text of one prompt."""

    base_url: str
    model: str
    system: str | None = None
    temperature: float = 0.1
    timeout: int = 180
    json_answer: bool = False

    def messages(self, content) -> list[dict]:
        head = [{"role": "system", "content": self.system}] if self.system else []
        return [*head, {"role": "user", "content": content}]

    def complete(self, content, timeout: int | None = None, **options) -> dict:
        body = {
            "model": self.model,
            "messages": self.messages(content),
            "temperature": self.temperature,
            **({"response_format": {"type": "json_object"}} if self.json_answer else {}),
            **options,
        }
        request = urllib.request.Request(
            self.base_url.rstrip("/") + "/chat/completions",
            data=json.dumps(body).encode(),
            headers={"Content-Type": "application/json"},
        )
        with urllib.request.urlopen(request, timeout=timeout or self.timeout) as reply:
            return json.load(reply)

    def __call__(self, prompt: str) -> str:
        return self.ask(prompt)[0]

    def ask(self, prompt: str) -> tuple[str, int | None]:
        """Answer and the number of its tokens, where the server tells it."""
        told = self.complete(prompt)
        return told["choices"][0]["message"]["content"] or "", (told.get("usage") or {}).get("completion_tokens")

    def warm_up(self) -> None:
        """A call that makes the server load the model, so that the first answer is not the slowest."""
        self.complete(WARM_UP, timeout=WARM_UP_SECONDS)


@dataclass(frozen=True)
class HttpDescriber:
    chat: HttpChat
    prompt: str = OCR_PROMPT

    def __call__(self, image: bytes, mime: str) -> str | None:
        data = f"data:{mime};base64,{base64.b64encode(image).decode()}"
        content = [
            {"type": "text", "text": self.prompt},
            {"type": "image_url", "image_url": {"url": data}},
        ]
        return self.chat.complete(content, max_tokens=2048)["choices"][0]["message"]["content"]


def describe_image(image: bytes | None, mime: str | None, describer: Describer | None) -> str | None:
    """Description or None; never raises. Unknown types are sent as PNG."""
    if not image or describer is None:
        return None
    kind = mime if mime and mime.startswith("image/") else "image/png"
    for attempt in range(VISION_ATTEMPTS):
        try:
            return (describer(image, kind) or "").strip() or None
        except Exception:  # noqa: BLE001 - the image is skipped
            if attempt + 1 < VISION_ATTEMPTS:
                time.sleep(VISION_BACKOFF_SECONDS)
    return None


def describe_column(describer: Describer | None):
    @F.pandas_udf(T.StringType())
    def describe(image: pd.Series, mime: pd.Series) -> pd.Series:
        return pd.Series(
            [describe_image(i, m, describer) for i, m in zip(image, mime)], dtype=object
        )

    return describe


def describe_all_column(describer: Describer | None):
    """``array<struct<page_number, mime, data>> -> array<struct<page_number, text>>``.

    Pictures that could not be described are left out; the order is kept.
    """
    told = T.StructType(
        [T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType())]
    )

    @F.pandas_udf(T.ArrayType(told))
    def describe(pictures: pd.Series) -> pd.Series:
        def one(found) -> list[dict] | None:
            if found is None:
                return None
            texts = [(p["page_number"], describe_image(p["data"], p["mime"], describer)) for p in found]
            return [{"page_number": n, "text": text} for n, text in texts if text]

        return pd.Series([one(found) for found in pictures], dtype=object)

    return describe


def _asked(chat: Chat, prompt: str) -> tuple[str, int | None, bool]:
    """Answer, tokens, whether the model failed; a failure's reason stands for the answer."""
    try:
        ask = getattr(chat, "ask", None)
        return (*(ask(prompt) if ask else (chat(prompt), None)), False)
    except Exception as problem:  # noqa: BLE001 - a failing model must not fail the job
        return f"[ERREUR: {problem}]", None, True


def _answered(chat: Chat, prompts: list[str]) -> list[tuple[str, float, int | None, bool]]:
    """Answers with seconds; a model with a ``batch`` method is asked once, and prompt by prompt if that fails."""
    together = getattr(chat, "batch", None)
    if together is not None and prompts:
        start = time.time()
        try:
            told = list(together(prompts))
        except Exception:  # noqa: BLE001 - one bad prompt must not spoil the others
            told = []
        if len(told) == len(prompts):
            each = round((time.time() - start) / len(prompts), 1)
            return [(text, each, tokens, False) for text, tokens in told]
    out = []
    for prompt in prompts:
        start = time.time()
        text, tokens, failed = _asked(chat, prompt)
        out.append((text, round(time.time() - start, 1), tokens, failed))
    return out


@lru_cache(maxsize=64)
def _warmed(chat: Chat) -> None:
    """Warm a model up, once per worker process for models that compare equal."""
    try:
        chat.warm_up()
    except Exception:  # noqa: BLE001 - the answers will tell
        return


def chat_column(chat: Chat):
    """``prompt -> struct<raw, elapsed_s, tokens, failed>``; a failure becomes the answer text.

    A model may have ``ask`` (answer and tokens), ``batch`` (the same for a list of prompts) and ``warm_up``.
    """

    @F.pandas_udf("raw string, elapsed_s double, tokens long, failed boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            if len(prompts) and hasattr(chat, "warm_up"):
                _warmed(chat)
            told = _answered(chat, prompts.tolist())
            frame = pd.DataFrame(told, columns=["raw", "elapsed_s", "tokens", "failed"])
            frame["tokens"] = frame["tokens"].astype("Int64")
            yield frame.astype({"elapsed_s": "float64", "failed": "bool"})

    return ask


def answer_column(chat: Chat):
    """``text -> JSON answer``; NULL where the model failed."""

    @F.pandas_udf(T.StringType())
    def answer(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(chat(text))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    return answer


def extractive_answer(text: Column, keywords: Column | None = None) -> Column:
    """Offline analysis as the JSON a model would return: lead sentence, top terms.

    The terms are those most frequent in the text, unless ``keywords`` (an array) is given.
    """
    from lorekeep.functions.text import strip
    from lorekeep.functions.tokens import Tokenizer, term_counts

    lead = strip(F.substring(F.regexp_extract(text, r"(?s)^\s*(.*?[.!?\n]|.*)", 1), 1, 300))
    if keywords is not None:
        return F.to_json(F.struct(lead.alias("summary"), keywords.alias("keywords")))
    counts = F.filter(
        term_counts(Tokenizer().tokens(text)), lambda t: F.length(t["term"]) > 3
    )
    ranked = F.sort_array(
        F.transform(counts, lambda t: F.struct((-t["tf"]).alias("n"), t["term"].alias("term")))
    )
    words = F.transform(F.slice(ranked, 1, 5), lambda t: t["term"])
    return F.to_json(F.struct(lead.alias("summary"), words.alias("keywords")))
