"""Statistics of arrays, and random draws from the run's generator."""

from __future__ import annotations

import math
import random

from docsluice.functions import steps, values
from docsluice.functions.core import mark
from docsluice.functions.numeric import tidy
from docsluice.lang.values import Raised, as_float, kind, whole


def numbers(a):
    return [as_float(x) for x in a if kind(x) == "number"]


def stat(name, f):
    @values(name, arity=1)
    def run(_, a):
        if not isinstance(a, list):
            raise Raised(f"{name}: an array is required")
        xs = numbers(a)
        return tidy(f(xs)) if xs else None


def quantile(xs, q):
    xs = sorted(xs)
    at = (len(xs) - 1) * q
    low = math.floor(at)
    high = min(low + 1, len(xs) - 1)
    return xs[low] + (xs[high] - xs[low]) * (at - low)


def variance(xs):
    mean = math.fsum(xs) / len(xs)
    return math.fsum((x - mean) ** 2 for x in xs) / len(xs)


stat("sum", lambda xs: float(sum(xs)))
stat("avg", lambda xs: sum(xs) / len(xs))
stat("median", lambda xs: quantile(xs, 0.5))
stat("variance", variance)
stat("stddev", lambda xs: math.sqrt(variance(xs)))
values("count", arity=1)(lambda _, a: len(a))


@values("quantile", arity=2)
def _(_, a, q):
    xs = numbers(a)
    if not 0 <= q <= 1:
        raise Raised("quantile must lie between 0 and 1")
    return tidy(quantile(xs, as_float(q))) if xs else None


class Xoshiro(random.Random):
    """The generator xoshiro256**, whose state SplitMix64 makes of a seed; without a seed, of the system's entropy."""

    def __init__(self, seed=None):
        super().__init__()
        at = random.SystemRandom().getrandbits(64) if seed is None else seed % (1 << 64)
        self.words = []
        for _ in range(4):  # fixed values: the increment and the factors of SplitMix64
            at = (at + 0x9E3779B97F4A7C15) % (1 << 64)
            x = (at ^ at >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            self.words.append(x ^ x >> 31)

    def next(self):
        turned = lambda x, n: (x << n | x >> 64 - n) % (1 << 64)
        a, b, c, d = self.words
        out = turned(b * 5 % (1 << 64), 7) * 9 % (1 << 64)
        c, d = c ^ a, d ^ b
        self.words = [a ^ d, b ^ c, c ^ (b << 17) % (1 << 64), turned(d, 45)]
        return out

    def random(self):
        return (self.next() >> 11) / (1 << 53)

    def getrandbits(self, k):
        out = 0
        for n in range(0, k, 64):
            out |= self.next() << n
        return out >> (-k % 64)


@steps("rand")
def _(env, v, path):
    yield env.run.random.random(), mark(path)


@values("rand", arity=1)
def _(v, seed):
    return Xoshiro(whole(seed)).random()


def between(rng, low, high):
    if high <= low:
        raise Raised("randint needs a range that isn't empty")
    return rng.randrange(whole(low), whole(high))


@steps("randint", arity=1)
def _(env, v, path, f):
    for n, _ in f(env, v, None):
        yield between(env.run.random, 0, n), mark(path)


@steps("randint", arity=2)
def _(env, v, path, f, g):
    for a, _ in f(env, v, None):
        for b, _ in g(env, v, None):
            yield between(env.run.random, a, b), mark(path)


@steps("choice", arity=1)
def _(env, v, path, f):
    for a, _ in f(env, v, None):
        if not a:
            raise Raised("choice of an empty array")
        yield env.run.random.choice(a), mark(path)


@steps("sample", arity=1)
def _(env, v, path, f):
    for n, _ in f(env, v, None):
        yield env.run.random.sample(v, min(len(v), max(0, whole(n)))), mark(path)


@steps("shuffle")
def _(env, v, path):
    out = list(v)
    env.run.random.shuffle(out)
    yield out, mark(path)
