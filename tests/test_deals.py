"""Deals over several sentences."""

from tessera.functions import deals as D


def read(text):
    return [(d.slots, d.parts) for d in D.deals_of(text)]


def test_a_deal_in_three_sentences():
    said = {"step": "announced", "kind": "units", "count": 2e6, "price": 0.5, "currency": "CAD", "total": 1e6}
    ways = [
        "Acme announces a placement. It will issue 2,000,000 units at C$0.50 per unit. Gross proceeds will be C$1,000,000.",
        "Acme announces a placement of 2 million units at a price of C$0.50 per unit for gross proceeds of C$1 million.",
        "For total proceeds of C$1.0 million, at C$0.50 per unit, Acme announced an issue. The 2,000,000 units will be sold soon.",
    ]
    for text in ways:
        assert read(text) == [(said, [])], text


def test_two_deals_and_parts():
    text = "Acme closed the first tranche for proceeds of $400,000 of a sale of 1,000,000 shares at $1.00 per share. The second tranche brought in $600,000.\n\nIt also announces 500 notes for US$500,000."
    one, two = read(text)
    assert one[0]["kind"] == "shares" and one[0]["price"] == 1.0 and [p for p, _ in one[1]] == [1, 2]
    assert one[1][1] == (2, 600_000.0)
    assert two == ({"step": "announced", "kind": "notes", "count": 500.0, "total": 500_000.0, "currency": "USD"}, [])


def test_figures_that_do_not_add_up_are_two_deals():
    assert len(read("It sold 100 units at $2.00 per unit. Proceeds were $200.")) == 1
    assert len(read("It sold 100 units at $2.00 per unit. Proceeds were $900.")) == 2
    assert len(read("It sold 100 units. It sold 200 units.")) == 2


def test_nothing_and_long_texts(spark):
    assert read("") == [] and read("No deal here. Acme closes early.") == [] and read("units per share at price") == []
    assert len(read("It sold 100 units at $2.00 per unit " * 300)) >= 1
    rows = [(1, "It sold 100 units at $2.00 per unit.", "x"), (None, "Proceeds of €5 million.", "x"), (2, None, "x"), (3, "", "x")]
    frame = spark.createDataFrame(rows, "id long, body string, step string")
    got = {r.id: r for r in D.deals_in(frame, "id", "body").collect()}
    assert set(got) == {1, None} and got[1].total == 200.0 and got[1].derived and got[None].currency == "EUR" and got[None].total == 5e6
    r = got[1]
    assert rows[0][1][r.span_start : r.span_end] == "100 units at $2.00 per unit"
    assert D.deals_in(frame.limit(0), "id", "body").count() == 0
