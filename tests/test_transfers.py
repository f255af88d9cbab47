import random

from branchlight.operators.transfers import branch_balance, propose_transfers
from branchlight.functions import stock as S

BAL = ("branch_code string, product_code string, product_name string, item_category1 string, item_category2 string, "
       "Last_on_hand long, avg_daily_sales double, coverage_days double")


def greedy(table, low, high):
    """Needy branches in name order take from donors in name order, amounts cut to whole units once."""
    out = []
    for product in {r[1] for r in table}:
        mine = sorted(r for r in table if r[1] == product and r[7] is not None)
        need = [[r[0], int((low - r[7]) * r[6])] for r in mine if r[7] < low]
        offer = [[r[0], int((r[7] - high) * r[6])] for r in mine if r[7] > high]
        for n in need:
            for o in offer:
                move = min(n[1], o[1])
                if move > 0:
                    out.append((product, o[0], n[0], move))
                    n[1] -= move
                    o[1] -= move
    return sorted(out)


def test_overlaps_equal_the_greedy_loop(spark):
    rnd = random.Random(5)
    table = []
    for p in range(40):
        for b in "ABCDEFG":
            rate = rnd.choice([0.0, 0.5, 2.0, 8.0])
            stock = rnd.randint(-2, 300)
            table.append((b, f"p{p}", "n", "c", "d", stock, rate, stock / rate if rate else None))
    got = propose_transfers(spark.createDataFrame(table, BAL), 7, 30).collect()
    assert sorted((r.product_code, r.from_branch, r.to_branch, r.transfer_qty) for r in got) == greedy(table, 7, 30)


def test_balance_leaves_out_silent_branches_and_empty_rows(spark):
    import datetime as dt
    d = dt.date(2024, 1, 1)
    sales = spark.createDataFrame([("a", "N", d, 4.0), ("a", "N", d, 2.0), ("a", "N", d + dt.timedelta(days=1), 6.0)],
                                  "product_code string, branch_code string, sale_date date, quantity_sold double")
    stock = spark.createDataFrame([("a", "N", 18), ("b", "N", 0), ("c", "N", 5), ("a", "S", 9)],
                                  "product_code string, branch_code string, Last_on_hand long").selectExpr(
        "*", "'x' AS product_name", "'y' AS item_category1", "'z' AS item_category2")
    got = {r.product_code: r for r in branch_balance(sales, stock).collect()}
    assert set(got) == {"a", "c"} and got["a"].branch_code == "N"
    assert got["a"].avg_daily_sales == 6.0 and got["a"].coverage_status == S.SHORTAGE
    assert got["c"].coverage_days is None and got["c"].coverage_status == S.SURPLUS
