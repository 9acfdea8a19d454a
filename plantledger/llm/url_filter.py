"""URL filters: rules for hosts and paths first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



class Rule(NamedTuple):
    """Fits its host and all subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The labelled URLs. Trailing words are what such sites tend to have in their names.
BLOCKED = """
http://casino-royal.example.com/en/12 https://blog.bestcasino.example.net/de/44.html
https://m.play-casino-online.example.org/fr/7 http://www.casino-win-big.example.com/es/3/
https://poker-bets.example.net/en/18?page=2&ref=x https://free-bets-now.example.org/en/9#top
http://blog.sports-bets.example.com/fr/310?utm_source=feed https://m.bet-free-spins.example.net/en/51/
https://www.jackpot-win.example.org/de/88 http://lucky-win.example.com/es/4.html
https://adult-videos.example.net/en/71 https://blog.adult-dating.example.org/en/12
http://m.adult-x-cams.example.com/de/44.html https://www.xxx-adult.example.net/fr/7
https://hot-x-clips.example.org/es/3/ http://cheap-pills-shop.example.com/en/18?page=2&ref=x
https://blog.pills-online.example.net/en/9#top https://m.cheap-meds.example.org/fr/310?utm_source=feed
http://www.diet-pills.example.com/en/51/ https://buy-pills-cheap.example.net/de/88
https://cheap-watches.example.org/es/4.html http://blog.spam-links.example.com/en/71
https://m.link-farm.example.net/en/12 https://www.spam-farm-seo.example.org/de/44.html
http://content-farm.example.com/fr/7 https://spam-blast.example.net/es/3/
https://blog.seo-spam.example.org/en/18?page=2&ref=x http://m.ads-server.example.com/en/9#top
https://www.ads-track-pixel.example.net/fr/310?utm_source=feed https://track-click.example.org/en/51/
http://ad-track.example.com/de/88 https://blog.adtracker.example.net/es/4.html
https://m.banner-ads.example.org/en/71 http://www.pop-ads.example.com/en/12
https://malware-download.example.net/de/44.html https://free-money-win.example.org/fr/7
http://blog.payday-loans.example.com/es/3/ https://m.free-gift-card.example.net/en/18?page=2&ref=x
https://www.click-ads.example.org/en/9#top
""".split()
ALLOWED = """
http://city-library.example.com/en/12 https://blog.tinkering.example.net/de/44.html
https://m.therapy-news.example.org/fr/7 http://www.university.example.com/es/3/
https://weather.example.net/en/18?page=2&ref=x https://thinking.example.org/en/9#top
http://blog.theatre.example.com/fr/310?utm_source=feed https://m.station.example.net/en/51/
https://www.museum-west.example.org/de/88 http://garden.example.com/es/4.html
https://nation.example.net/en/71 https://blog.recipes.example.org/en/12
http://m.the-herald.example.com/de/44.html https://www.northern.example.net/fr/7
https://health.example.org/es/3/ http://physics.example.com/en/18?page=2&ref=x
https://blog.kitchen.example.net/en/9#top https://m.travel-notes.example.org/fr/310?utm_source=feed
http://www.bridge-design.example.com/en/51/ https://tribune.example.net/de/88
https://thesis.example.org/es/4.html http://blog.english.example.com/en/71
https://m.farming.example.net/en/12 https://www.adulthood.example.org/de/44.html
http://additions.example.com/fr/7 https://railway.example.net/es/3/
https://blog.ocean.example.org/en/18?page=2&ref=x http://m.than-rest.example.com/en/9#top
https://www.edition.example.net/fr/310?utm_source=feed https://threshold.example.org/en/51/
http://handbook.example.com/de/88 https://blog.ordinance.example.net/es/4.html
https://m.reading.example.org/en/71 http://www.weather-station.example.com/en/12
https://trout.example.net/de/44.html https://school-board.example.org/fr/7
http://blog.winter.example.com/es/3/ https://m.spanish.example.net/en/18?page=2&ref=x
https://www.pillar.example.org/en/9#top http://betterment.example.com/fr/310?utm_source=feed
https://exercise.example.net/en/51/
""".split()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NGRAMS = (2, 3, 4, 5)
DIMENSIONS = 1 << 16
ROUNDS, RATE, DECAY = 300, 2.0, 1e-4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or url."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each marked with its part; the last label of a host says little and goes."""
    names = host.rpartition(".")[0] or host
    found = []
    for mark, part in (("h", f"^{names}$"), ("p", f"^{path}$")):
        for n in NGRAMS:
            found += [zlib.crc32((mark + part[i:i + n]).encode()) % DIMENSIONS for i in range(len(part) - n + 1)]
    return np.unique(np.array(found, dtype=np.int64))


def _plain_split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2].partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


@cache
def trained() -> tuple[np.ndarray, float]:
    """Weights and bias of the regression on the labelled table, by full gradient steps from zero: always the same."""
    rows = [features(*_plain_split(u)) for u in (*BLOCKED, *ALLOWED)]
    labels = np.array([1.0] * len(BLOCKED) + [0.0] * len(ALLOWED))
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i, row] = 1 / np.sqrt(max(1, len(row)))
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    weights, bias = np.zeros(len(used)), 0.0
    for _ in range(ROUNDS):
        off = 1 / (1 + np.exp(-(x @ weights + bias))) - labels
        weights -= RATE * (x.T @ off / len(labels) + DECAY * weights)
        bias -= RATE * off.mean()
    whole = np.zeros(DIMENSIONS)
    whole[used] = weights
    return whole, bias


@F.pandas_udf(T.DoubleType())
def _blocked(host: pd.Series, path: pd.Series) -> pd.Series:
    weights, bias = trained()
    out = []
    for h, p in zip(host, path):
        found = features(h, p)
        out.append(1 / (1 + np.exp(-(weights[found].sum() / np.sqrt(max(1, len(found))) + bias))))
    return pd.Series(out, dtype="float64")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. ``rules`` is a list in the program, not a table."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(_id, host, path, rule, verdict, score) of every row; no shuffle, one Arrow pass over host and path.

    The longest fitting rule decides; else the regression does: ``block`` from ``threshold`` on. Null urls and those
    without ``://`` have an empty host and path, so no rule with a path fits and the regression judges two empty
    names. Repeated rows stay repeated, an empty table gives an empty result, other columns are not read.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "_decided": verdict, "score": _blocked("host", "path")})
    said = F.coalesce("_decided", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("_id", "host", "path", "rule", said.alias("verdict"), "score")
