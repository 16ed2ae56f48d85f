import pytest
from pyspark.sql import functions as F

from parley.operators import filters, listings

PEOPLE = "id int, nickname string, remark string, wxid string, account_id int, is_active int"


@pytest.fixture
def people(rows):
    return rows(
        PEOPLE,
        (1, "Ann", "100%", "w1", 1, 1),
        (2, "ANNA", "a_b", "w2", 1, 0),
        (3, "José", "axb", "W1", 2, 1),
        (4, None, None, None, None, 0),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search_ignores_case_and_takes_text_literally(people):
    assert ids(filters.search_contains(people, {"nickname": "ann"})) == [1, 2]
    assert ids(filters.search_contains(people, {"remark": "%"})) == [1]
    assert ids(filters.search_contains(people, {"remark": "A_B"})) == [2]
    assert ids(filters.search_contains(people, {"remark": "a_b"}, escape=False)) == [2, 3]
    assert ids(filters.search_contains(people, {"nickname": "n", "remark": "%"})) == [1]


def test_search_with_accents_ignored(people):
    assert ids(filters.search_contains(people, {"nickname": "JOSE"}, collation="UNICODE_CI_AI")) == [3]
    assert ids(filters.search_contains(people, {"nickname": "ann"}, collation="UTF8_BINARY")) == []


def test_empty_inputs_do_not_filter_but_zero_does(people):
    assert ids(filters.apply_filters(people, {"nickname": "", "id": None})) == [1, 2, 3, 4]
    assert ids(filters.apply_filters(people, {"is_active": "0"})) == [2, 4]
    assert ids(filters.apply_filters(people, {"wxid": "w1", "is_active": "1"})) == [1, 3]
    assert ids(filters.apply_filters(people, {"id": "x"})) == []
    assert ids(filters.apply_filters(people, {"id": 2})) == [2]


def test_pages_make_up_the_sorted_whole(people):
    order = [F.desc("is_active"), F.asc("id")]
    whole = [r.id for r in people.orderBy(*order).collect()]
    pages = [filters.paginate(people, order, p, 3).collect() for p in (1, 2, 3)]
    assert [r.id for page in pages for r in page] == whole
    assert {(r.total_rows, r.total_pages) for page in pages for r in page} == {(4, 2)}
    assert pages[2] == []


def test_lookup_takes_the_lowest_id(people):
    assert filters.lookup_one(people, {"account_id": 1}).first().id == 1
    assert filters.lookup_one(people, {"account_id": 9}).first() is None


def test_pairs_and_parties(rows):
    messages = rows(
        "id int, from_user string, to_user string",
        (1, "a", "b"), (2, "b", "a"), (3, "a", "c"), (4, "a", "a"), (5, None, "a"),
    )
    assert ids(filters.between_parties(messages, "a", "b")) == [1, 2]
    assert ids(filters.involving(messages, "a")) == [1, 2, 3, 4, 5]
    assert ids(filters.by_party(messages).where("party = 'a'")) == [1, 2, 3, 4, 5]


def test_membership_by_literals_and_by_table(people, rows):
    assert ids(filters.filter_in(people, "wxid", ["w1", "w2"])) == [1, 2]
    keys = rows("k string", ("w1",), ("w1",), (None,))
    assert ids(filters.filter_in(people, "wxid", keys)) == [1]


def test_name_conflicts_need_another_id(rows):
    admins = rows("id int, username string", (1, "x"), (2, "x"), (3, "y"), (4, "Z"))
    asked = rows("id int, username string", (1, "x"), (3, "y"), (9, "z"), (9, "new"), (None, "q"))
    assert ids(filters.name_conflicts(asked, admins)) == [1, 9]


def test_row_checks(rows):
    df = rows(
        "id int, name string, start_time string",
        (1, "a", "2024-01-01 00:00:00"), (2, "", ""), (3, None, "2024-01-01"), (4, "b", None),
        (5, "c", "2024-01-01 00:00:00\n"),
    )
    errors = {r.id: r.errors for r in filters.validate_rows(df, ["name"]).collect()}
    bad_time = "start_time has no valid format"
    assert errors == {1: [], 2: ["name is required"], 3: ["name is required", bad_time], 4: [], 5: [bad_time]}


def test_lengths(rows):
    df = rows("id int, username string", (1, "u" * 25), (2, "漢" * 26), (3, None))
    errors = {r.id: r.errors for r in filters.check_lengths(df, "admin").collect()}
    assert errors == {1: [], 2: ["username is longer than 25"], 3: []}


def test_select_and_equality(people):
    renamed = filters.select_cols(people, {"key": "id", "nickname": "nickname"})
    assert renamed.columns == ["key", "nickname"]
    assert filters.select_cols(people, ["id"]).columns == ["id"]
    assert ids(filters.filter_eq(people, {"account_id": 1, "is_active": 0})) == [2]
    assert filters.filter_eq(people, {}).count() == 4


def test_admins_are_shown_without_password_and_with_login_text(rows):
    admins = rows(
        "id int, username string, password string, last_login_time int, is_delete int",
        (1, "a", "p", 0, 0), (2, "b", "p", 1700000000, 0), (3, "c", "p", 0, 1),
    )
    got = {r.id: (r.password, r.last_login_time) for r in listings.admin_listing(admins).collect()}
    assert got == {1: ("", "还没登录过"), 2: ("", "2023-11-15 06:13:20")}


def test_listing_orders_and_joins_the_page(people, rows):
    accounts = rows("id int, nickname string, avatar string", (1, "own", "pic"))
    friends = people.withColumns({"ai_active": F.lit(0), "ai_reply": F.lit(1)})
    page = listings.friend_listing(friends, accounts, {}, 1, 3).collect()
    assert [r.id for r in page] == [3, 1, 2]
    assert [r.ow_nickname for r in page] == [None, "own", "own"]
    assert (page[0].is_active, page[0].total_rows) == ("1", 4)


def test_friend_counts(rows):
    accounts = rows("id int, friend_count long", (1, 99), (2, 99))
    friends = rows("account_id int", (1,), (1,), (None,))
    got = {r.id: r.friend_count for r in listings.account_friend_counts(accounts, friends).collect()}
    assert got == {1: 2, 2: 0}
