"""Operators on token distributions: array columns of logits, one array a row, so that no row is exploded or shuffled.

A masked token is a null entry; positions are token numbers from 0.  Ranks put greater logits first and smaller tokens first
among equals.  Every filter returns the logits with what it drops masked; at least the greatest stays unless stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_sum(logits: Column) -> Column:
    """Logarithm of the sum of exponentials, shifted by the greatest."""
    return bound(F.array_max(logits), lambda top: top + F.ln(total(F.transform(logits, lambda x: F.exp(x - top)))))


def log_softmax(logits: Column) -> Column:
    return bound(log_sum(logits), lambda z: F.transform(logits, lambda x: x - z))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x))))


def mask(logits: Column, keep: Callable[..., Column]) -> Column:
    """Masks where ``keep`` of the logit (and its token) doesn't hold."""
    return F.transform(logits, lambda x, i: F.when(keep(x, i), x))


def ranked(logits: Column, p: Column | None = None) -> Column:
    """Array of (logit, token, p) from the greatest on; masked tokens are left out."""
    p = softmax(logits) if p is None else p
    rows = F.filter(F.transform(F.arrays_zip(logits.alias("x"), p.alias("p")), lambda r, i: F.struct((-r.x).alias("negative"), i.alias("token"), r.p.alias("p"), r.x.alias("logit"))), lambda r: r.logit.isNotNull())
    return F.transform(F.array_sort(rows), lambda r: F.struct(r.logit.alias("logit"), r.token.alias("token"), r.p.alias("p")))


def only(logits: Column, tokens: Column) -> Column:
    """Masks all but ``tokens``."""
    return bound(tokens, lambda t: mask(logits, lambda x, i: F.array_contains(t, i)))


def tokens_of(rows: Column) -> Column:
    return F.transform(rows, lambda r: r.token)


def running(values: Column) -> Column:
    """Sums up to each place, itself included."""
    step = lambda s, x: F.struct(F.concat(s.done, F.array(s.sum + x)).alias("done"), (s.sum + x).alias("sum"))
    return F.aggregate(values, F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("sum")), step, lambda s: s.done)


def temperature(logits: Column, t: float) -> Column:
    if t <= 0:
        raise ValueError("a temperature is above 0")
    return F.transform(logits, lambda x: x / t)


def dynamic_temperature(logits: Column, low: float, high: float, exponent: float = 1.0) -> Column:
    """The temperature between two bounds by the entropy's share of its maximum, over tokens that aren't masked."""
    live = F.size(F.filter(logits, lambda x: x.isNotNull()))
    share = F.when(live > 1, entropy(softmax(logits)) / F.ln(live.cast("double"))).otherwise(0.0)
    return F.lit(low) + F.lit(high - low) * F.pow(F.greatest(share, F.lit(0.0)), F.lit(float(exponent)))


def quadratic_smoothing(logits: Column, factor: float, curve: float) -> Column:
    """The maximum less k s d^2, plus c s d^3, with d the (negative) distance from the maximum."""
    k, c = (3 - curve) / 2, (curve - 1) / 2
    return bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: -(k * factor * (x - top) * (x - top)) + c * factor * (x - top) * (x - top) * (x - top) + top))


def top_k(logits: Column, k: int) -> Column:
    return only(logits, tokens_of(F.slice(ranked(logits), 1, k)))


def _head(logits: Column, rows: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """Keeps the ranked rows for which ``keep`` of the mass before them (rounded) and the row holds."""

    def cut(rows: Column) -> Column:
        before = bound(running(F.transform(rows, lambda r: r.p)), lambda sums: F.transform(sums, lambda s, i: F.round(s - F.get(rows, i).p, 9)))
        kept = F.filter(F.arrays_zip(rows.alias("r"), before.alias("b")), lambda x: keep(x.b, x.r))
        return only(logits, F.transform(kept, lambda x: x.r.token))

    return bound(rows, cut)


def top_p(logits: Column, mass: float) -> Column:
    """The smallest head with at least ``mass``."""
    return _head(logits, ranked(logits), lambda before, r: before < mass)


def min_p(logits: Column, share: float) -> Column:
    """Tokens of at least ``share`` of the greatest probability."""
    return bound(F.array_max(logits), lambda top: mask(logits, lambda x, i: F.exp(x - top) >= share))


def top_a(logits: Column, a: float) -> Column:
    """Tokens of at least ``a`` times the square of the greatest probability."""
    return bound(softmax(logits), lambda p: bound(a * F.array_max(p) * F.array_max(p), lambda low: mask(logits, lambda x, i: F.get(p, i) >= low)))


def deviation(logits: Column) -> Column:
    """The sample deviation; masked tokens count as 0."""
    n = F.size(logits)
    mean = total(logits) / n
    return bound(mean, lambda m: F.sqrt(total(F.transform(logits, lambda x: F.pow(F.coalesce(x, F.lit(0.0)) - m, 2))) / (n - 1)))


def top_n_sigma(logits: Column, n: float) -> Column:
    """Logits within ``n`` deviations of the greatest."""
    return bound(F.array_max(logits) - n * deviation(logits), lambda low: mask(logits, lambda x, i: x >= low))


def tail_free(logits: Column, z: float) -> Column:
    """Cuts where the running share of absolute second differences passes ``z``; the first stays, the last always goes."""

    def cut(rows: Column) -> Column:
        p = lambda i: F.get(rows, i).p
        bends = F.when(F.size(rows) > 2, F.transform(F.sequence(F.lit(0), F.size(rows) - 3), lambda i: F.abs(p(i) - 2 * p(i + 1) + p(i + 2)))).otherwise(F.array().cast("array<double>"))
        shares = bound(bends, lambda b: bound(total(b), lambda whole: F.transform(running(b), lambda s: F.round(s / whole, 9))))
        # the share up to a place decides on the next: the last place has none and goes
        keep = lambda s, i: F.when(i == 0, F.lit(True)).otherwise(F.coalesce((F.get(s, i - 1) <= z) & (i < F.size(rows) - 1), F.lit(False)))
        kept = bound(shares, lambda s: F.filter(F.transform(rows, lambda r, i: F.when(keep(s, i), r.token)), lambda t: t.isNotNull()))
        return only(logits, kept)

    return bound(ranked(logits), cut)


def typical(logits: Column, mass: float) -> Column:
    """The tokens whose surprise is closest to the entropy, up to ``mass``."""

    def cut(p: Column) -> Column:
        odd = bound(entropy(p), lambda h: F.filter(F.transform(p, lambda x, i: F.struct(F.round(F.abs(-F.ln(x) - h), 12).alias("odd"), i.alias("token"), x.alias("p"))), lambda r: r.p.isNotNull()))
        rows = F.transform(F.array_sort(odd), lambda r: F.struct(r.token.alias("token"), r.p.alias("p")))
        return _head(logits, rows, lambda before, _: before < mass)

    return bound(softmax(logits), cut)


def epsilon_cutoff(logits: Column, least: float) -> Column:
    """Tokens of a probability of at least ``least``; the greatest always."""
    return bound(softmax(logits), lambda p: mask(logits, lambda x, i: (F.get(p, i) >= least) | (x == F.array_max(logits))))


def eta_cutoff(logits: Column, least: float) -> Column:
    """As epsilon, with a bound that falls with the entropy: min(least, sqrt(least) * exp(-entropy))."""
    return bound(softmax(logits), lambda p: bound(F.least(F.lit(least), F.lit(least**0.5) * F.exp(-entropy(p))), lambda low: mask(logits, lambda x, i: (F.get(p, i) >= low) | (x == F.array_max(logits)))))


def exclude_top(logits: Column, threshold: float, protected: tuple[int, ...] = (), draw: Column | None = None, probability: float = 1.0) -> Column:
    """Drops all tokens of at least ``threshold`` but the least likely of them; not where one of ``protected`` would go, or the draw fails."""

    def cut(rows: Column) -> Column:
        return bound(F.filter(F.transform(rows, lambda r, i: F.when(F.get(rows, i + 1).p >= threshold, r.token)), lambda t: t.isNotNull()), drop)

    def drop(gone: Column) -> Column:
        acts = ~F.arrays_overlap(gone, F.array(*map(F.lit, protected))) if protected else F.lit(True)
        acts = acts & (draw < probability) if draw is not None else acts
        return F.when(acts, mask(logits, lambda x, i: ~F.array_contains(gone, i))).otherwise(logits)

    return bound(ranked(logits), cut)


def logit_bias(logits: Column, bias: Column) -> Column:
    """Adds the entries of a map of token to bias."""
    return F.transform(logits, lambda x, i: x + F.coalesce(F.try_element_at(bias, i), F.lit(0.0)))


def recent(tokens: Column, range_: int) -> Column:
    """The last ``range_`` tokens; 0 means all."""
    return F.slice(tokens, F.greatest(F.size(tokens) - range_, F.lit(0)) + 1, range_) if range_ else tokens


def repetition_penalty(logits: Column, tokens: Column, penalty: float, range_: int = 0) -> Column:
    """Divides positive logits of tokens that stood before, and multiplies negative ones."""
    return bound(F.array_distinct(recent(tokens, range_)), lambda seen: F.transform(logits, lambda x, i: F.when(~F.array_contains(seen, i), x).when(x < 0, x * penalty).otherwise(x / penalty)))


def presence_penalty(logits: Column, tokens: Column, penalty: float, range_: int = 0) -> Column:
    return bound(F.array_distinct(recent(tokens, range_)), lambda seen: F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x - penalty).otherwise(x)))


def frequency_penalty(logits: Column, tokens: Column, penalty: float, range_: int = 0) -> Column:
    return bound(recent(tokens, range_), lambda seen: F.transform(logits, lambda x, i: x - penalty * F.size(F.filter(seen, lambda t: t == i))))


def dry_penalty(logits: Column, tokens: Column, multiplier: float, base: float, allowed: int, breakers: tuple[int, ...] = (), range_: int = 0, longest: int = 50) -> Column:
    """Lowers tokens that would go on a repeat: m * base^(length - allowed) for the longest earlier run that ends like the text and has the token next."""
    stops = F.array(*map(F.lit, breakers)) if breakers else F.array().cast("array<int>")

    def lower(seq: Column) -> Column:
        n = F.size(seq)
        last = F.get(seq, n - 1)

        def run_length(i: Column) -> Column:
            """How many tokens up to place i equal those at the end, up to a breaker."""
            back = F.sequence(F.lit(0), F.least(i, F.lit(longest - 1)))
            differs = F.filter(back, lambda k: (F.get(seq, i - k) != F.get(seq, n - 1 - k)) | F.array_contains(stops, F.get(seq, n - 1 - k)))
            return F.coalesce(F.array_min(differs), F.size(back))

        places = F.when((n > 1) & ~F.array_contains(stops, last), F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(seq, i) == last) & ~F.array_contains(stops, F.get(seq, i + 1)))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(places, lambda i: F.struct(F.get(seq, i + 1).alias("next"), run_length(i).alias("length")))
        return bound(runs, lambda r: F.transform(logits, lambda x, t: x - F.coalesce(_dry(F.array_max(F.transform(F.filter(r, lambda y: y.next == t), lambda y: y.length)), multiplier, base, allowed), F.lit(0.0))))

    return bound(recent(tokens, range_), lower)


def _dry(length: Column, multiplier: float, base: float, allowed: int) -> Column:
    return F.when(length >= allowed, multiplier * F.pow(F.lit(float(base)), (length - allowed).cast("double")))


def draw(p: Column, u: Column) -> Column:
    """The first place at which the running sum of ``p`` passes ``u`` of the whole."""
    sums = running(F.transform(p, lambda x: F.coalesce(x, F.lit(0.0))))
    return bound(sums, lambda s: F.coalesce(F.get(F.filter(F.transform(s, lambda x, i: F.when(x > u * F.element_at(s, -1), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(s) - 1))


def mirostat_step(logits: Column, mu: Column, tau: float, eta: float, u: Column) -> Column:
    """(token, mu): cuts surprises above mu, draws by ``u``, and moves mu against the draw's surprise."""

    def step(rows: Column) -> Column:
        head = F.filter(rows, lambda r: -F.log2(r.p) <= mu)
        kept = F.when(F.size(head) > 0, head).otherwise(F.slice(rows, 1, 1))

        def chosen(k: Column) -> Column:
            mass = total(F.transform(k, lambda r: r.p))
            place = draw(F.transform(k, lambda r: r.p), u)
            return F.struct(F.get(k, place).token.alias("token"), (mu - eta * (-F.log2(F.get(k, place).p / mass) - tau)).alias("mu"))

        return bound(kept, chosen)

    return bound(ranked(logits), step)


#: Fixed values of the adaptive transform.
_WIDTH, _PEAK, _SHARPNESS = 0.3, 5.0, 10.0


def adaptive_step(logits: Column, weighted: Column, weight: Column, target: float, decay: float, u: Column) -> Column:
    """(token, weighted, weight): favours tokens near a target that makes up for what was drawn before, draws by ``u``, and updates the mean."""
    decay = min(decay, 0.99)
    aim = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * target - F.when(weight > 0, weighted / weight).otherwise(target)))

    def step(p: Column) -> Column:
        bent = lambda x: F.abs(x - aim) / _WIDTH
        new = F.transform(p, lambda x: F.when(x.isNotNull(), _PEAK - _SHARPNESS * bent(x) * bent(x) / (1 + bent(x))))
        return bound(draw(softmax(new), u), lambda t: F.struct(t.alias("token"), (F.get(p, t) + decay * weighted).alias("weighted"), (1 + decay * weight).alias("weight")))

    return bound(softmax(logits), step)


def perplexity(nll: Column) -> Column:
    """The exponential of the plain mean of window means."""
    return F.exp(F.aggregate(nll, F.lit(0.0), lambda s, x: s + x) / F.size(nll))


#: The order in which steps are applied where no other is given.
ORDER = (
    "repetition_penalty", "presence_penalty", "frequency_penalty", "dry", "temperature", "dynamic_temperature", "quadratic_sampling", "top_n_sigma", "top_k", "top_p", "typical_p", "epsilon_cutoff",
    "eta_cutoff", "tfs", "top_a", "min_p", "adaptive_p", "mirostat", "xtc", "encoder_repetition_penalty", "no_repeat_ngram",
)
_TEMPERATURES = ("temperature", "dynamic_temperature", "quadratic_sampling")


def in_order(steps: dict[str, Callable[[Column], Column]], order: tuple[str, ...] = ORDER, temperature_last: bool = False) -> list[str]:
    """Names of ``steps`` by their place in ``order``; unknown ones come first, and the temperatures last where asked for."""
    if temperature_last:
        order = (*(x for x in order if x not in _TEMPERATURES), *(x for x in order if x in _TEMPERATURES))
    return sorted(steps, key=lambda name: order.index(name) if name in order else -1)


def apply_steps(logits: Column, steps: dict[str, Callable[[Column], Column]], order: tuple[str, ...] = ORDER, temperature_last: bool = False) -> Column:
    return reduce(lambda x, name: bound(x, steps[name]), in_order(steps, order, temperature_last), logits)


def top_tokens(logits: Column, k: int, actual: Column | None = None) -> Column:
    """The ``k`` likeliest as (token, logprob, rank); with ``actual`` that token comes first and the best others follow, k in all."""
    rows = F.transform(ranked(logits, log_softmax(logits)), lambda r, i: F.struct(r.token.alias("token"), r.p.alias("logprob"), (i + 1).alias("rank")))
    if actual is None:
        return F.slice(rows, 1, k)
    return bound(rows, lambda r: F.concat(F.filter(r, lambda x: x.token == actual), F.slice(F.filter(r, lambda x: x.token != actual), 1, k - 1)))


def escaped(token: Column) -> Column:
    """A token's text with control characters as escapes."""
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        token = F.replace(token, F.lit(raw), F.lit(name))
    return token


def text_offsets(tokens: Column) -> Column:
    """Where each token's text starts in the whole."""
    lengths = F.transform(tokens, lambda t: F.length(t).cast("double"))
    return bound(running(lengths), lambda s: F.transform(s, lambda x, i: (x - F.get(lengths, i)).cast("int")))


def mirostat(steps: Column, draws: Column, tau: float, eta: float) -> Column:
    """The tokens drawn over an array of logit arrays, with mu carried from each to the next; it starts at twice tau."""
    carried = F.struct(F.array().cast("array<int>").alias("tokens"), F.lit(2.0 * tau).alias("mu"))
    both = F.arrays_zip(steps.alias("x"), draws.alias("u"))
    step = lambda s, b: bound(mirostat_step(b.x, s.mu, tau, eta, b.u), lambda r: F.struct(F.concat(s.tokens, F.array(r.token)).alias("tokens"), r.mu.alias("mu")))
    return F.aggregate(both, carried, step)


def adaptive(steps: Column, draws: Column, target: float, decay: float) -> Column:
    """The tokens drawn over an array of logit arrays, with the weighted mean of what was drawn carried on."""
    rest = 1 - min(decay, 0.99)
    carried = F.struct(F.array().cast("array<int>").alias("tokens"), F.lit(target / rest).alias("weighted"), F.lit(1 / rest).alias("weight"))
    both = F.arrays_zip(steps.alias("x"), draws.alias("u"))
    step = lambda s, b: bound(
        adaptive_step(b.x, s.weighted, s.weight, target, decay, b.u), lambda r: F.struct(F.concat(s.tokens, F.array(r.token)).alias("tokens"), r.weighted.alias("weighted"), r.weight.alias("weight"))
    )
    return F.aggregate(both, carried, step)
