"""Cells that reach into later rows: against a walk over every column, and in time that grows with the page."""

from __future__ import annotations

import random
import time

import pytest

from ledgerline.llm.html_text import Spans, to_text


@pytest.mark.parametrize("seed", range(30))
def test_places_of_cells_against_a_walk(seed):
    rng = random.Random(seed)
    spans, taken = Spans(), {}
    for n in range(40):
        spans.until(n)
        at, below, other, later = 0, [], 0, {}
        for _ in range(rng.randint(0, 6)):
            width, down = rng.randint(1, 5), rng.choice([1, 1, 2, 3, 9, 65534])
            at = spans.free(at)
            while other in taken:
                other += 1
            assert at == other
            if down > 1:
                below.append((at, at + width, n + down))
                later |= dict.fromkeys(range(other, other + width), down)
            at, other = at + width, other + width
        for cells in below:
            spans.take(*cells)
        taken = {k: v - 1 for k, v in (taken | later).items() if v > 1}


def test_row_spans_take_time_in_the_pages_length():
    def page(k, span):
        return "<table><tr>" + "".join(f"<td rowspan={span(i)} colspan=100>c{i}</td>" for i in range(k)) + "</tr>" + "<tr><td>x</td></tr>" * (10 * k) + "</table>"

    for span in (lambda i: 0, lambda i: 2 + 7 * i, lambda i: 20_000 - 3 * i):
        took = []
        for k in (500, 4000):  # 0.1 and 1 MB
            text = page(k, span)
            began = time.perf_counter()
            assert to_text(text).count("x") == 10 * k
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * took[0] + 1, took


def test_layout_of_spans_and_ruby():
    assert to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert to_text("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>").replace(" ", "") == "漢kan"
