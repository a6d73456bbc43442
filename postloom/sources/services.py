"""Embeddings and analysts behind plain functions: a service is whatever maps texts to vectors, or a prompt to an answer. Offline stand-ins are deterministic."""
import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text


class HashingEmbedder:
    """Texts -> vectors of norm 1 by signed hashes of their words."""

    model = "hashing"

    def __init__(self, dim=64):
        self.dim = dim

    def __call__(self, texts):
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)


class HttpEmbedder:
    """Texts -> vectors from a service that takes {"model", "input"} and gives {"embeddings"}. No connection, a refusal and an answer without vectors are told apart."""

    def __init__(self, url, model, timeout=60):
        self.url, self.model, self.timeout = url, model, timeout

    def __call__(self, texts):
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                got = json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"embedding service: status {e.code}") from e
        except urllib.error.URLError as e:
            raise ConnectionError(f"embedding service: {e.reason}") from e
        except ValueError as e:
            raise RuntimeError("embedding service: an answer that is no JSON") from e
        vectors = got.get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise RuntimeError("embedding service: an answer without a vector for each text")
        return np.array(vectors, float)


def bisected(embed, texts):
    """(vectors, {place: error}): a batch that fails is halved until the texts at fault stand alone; lost connections are no text's fault."""
    try:
        return list(embed(texts)), {}
    except ConnectionError:
        raise
    except Exception as e:
        if len(texts) == 1:
            return [None], {0: str(e)}
    half = len(texts) // 2
    a, bad = bisected(embed, texts[:half])
    b, more = bisected(embed, texts[half:])
    return a + b, bad | {k + half: v for k, v in more.items()}


def embed(df, embedder, out="embedding", content="content", batch=64):
    """df with vectors (null where a text can't be embedded)."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        got = []
        for at in range(0, len(texts), batch):
            got += bisected(embedder, texts.iloc[at : at + batch].fillna("").tolist())[0]
        return pd.Series([None if v is None else np.asarray(v, float) for v in got], dtype=object)

    return df.withColumn(out, run(text.sanitise(F.col(content).cast("string"))))


def embed_cached(df, embedder, cache, content="content"):
    """(df with vectors, rows to add to the cache): texts are looked up by key, and each unlike one that is not there is embedded once. cache: key, embedding, or None."""
    x = df.withColumn("key", text.cache_key(embedder.model, text.sanitise(F.coalesce(F.col(content), F.lit("")))))
    known = cache if cache is not None else df.sparkSession.createDataFrame([], "key string, embedding array<double>")
    missing = x.join(known, "key", "left_anti").groupBy("key").agg(F.min(content).alias("text"))
    new = embed(missing, embedder, content="text").select("key", "embedding").where("embedding is not null")
    return x.join(known.select("key", "embedding").unionByName(new), "key", "left").drop("key"), new


def reusable(posts, store, sidecar, config):
    """Whether stored vectors hold: the same settings, and every post is there."""
    return sidecar == config and posts.select("id").join(store.select("id"), "id", "left_anti").isEmpty()


class HttpAnalyst:
    """A prompt -> an answer, from a service that speaks one of two common chat forms; tried again with growing pauses."""

    def __init__(self, url, model, key=None, style="openai", extra=None, retries=3, timeout=120):
        self.url, self.model, self.key, self.style, self.extra, self.retries, self.timeout = url, model, key, style, extra or {}, retries, timeout

    def request(self, system, prompt, tokens=None):
        """(headers, body) of a call."""
        if self.style == "anthropic":
            head = {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"}
            body = {"model": self.model, "max_tokens": tokens or 4096, "system": system, "messages": [{"role": "user", "content": prompt}]}
        else:
            head = {"Authorization": f"Bearer {self.key}"} if self.key else {}
            body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]} | ({"max_tokens": tokens} if tokens else {})
        return {"Content-Type": "application/json"} | head, body | self.extra

    def answer_of(self, got):
        return got["content"][0]["text"] if self.style == "anthropic" else got["choices"][0]["message"]["content"]

    def __call__(self, prompt, system="", tokens=None, pause=time.sleep):
        head, body = self.request(system, prompt, tokens)
        for k in range(self.retries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                    return self.answer_of(json.loads(r.read()))
            except (OSError, ValueError, KeyError, IndexError):
                if k == self.retries - 1:
                    raise
                pause(2**k)

    def available(self):
        try:
            self("ping", tokens=1, pause=lambda s: None)
            return True
        except (OSError, ValueError, KeyError, IndexError):
            return False


def chat_config(config, section, env=os.environ):
    """Settings of a section's analyst: those of its model slot, overridden by its own; the key from <SLOT>_API_KEY."""
    own = {k: v for k, v in config.get(section, {}).items() if k in ("url", "model", "style", "extra", "retries", "timeout")}
    slot = config.get(section, {}).get("model_slot", "default")
    return config.get("models", {}).get(slot, {}) | own | {"key": env.get(f"{slot.upper()}_API_KEY")}
