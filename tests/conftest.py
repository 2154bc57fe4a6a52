from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


# Small tables with a blank cell, a repeated key and row, and six dated months.
EMPLOYEES = """id,name,city,salary
1,Ilze,Riga,3100
2,Pedro,Lisbon,2800
3,Maja,Oslo,4200
4,Joana,Lisbon,3600
5,Nils,Oslo,5000
6,Rui,Lisbon,2900
"""
PRODUCTS = """product,category,price
Kettle,Kitchen,40
Pan,Kitchen,25
Spade,Garden,45
Rake,Garden,16.5
Hoe,Garden,21
"""
CUSTOMERS = """customer_id,customer_name,city,email,age,annual_income
501,Ana Reis,Porto,ana@shop.test,51,41000
502,Bo Lind,Oslo,bo@shop.test,23,38500
502,Bo Lind,Oslo,bo@shop.test,23,38500
503,Cy Ozols,Riga,cy@shop.test,37,52000
504,Di Berg,Oslo,,44,61000
505,Ed Silva,Porto,ed@shop.test,29,33000
506,Fe Kalns,Riga,fe@shop.test,62,47500
507,Gil Moe,Bergen,gil@shop.test,34,70250
508,Hal Costa,Faro,hal@shop.test,48,45900
"""
DATED_SALES = """transaction_id,customer_id,product,category,city,quantity,amount,transaction_date
1,K9,Kettle,Kitchen,Lisbon,3,120.5,2025-03-02
2,K2,Spade,Garden,Oslo,1,45,2025-03-19
3,K4,Kettle,Kitchen,Oslo,2,80.5,2025-04-01
4,K7,Lamp,Home,Lisbon,4,200,2025-04-22
5,K1,Rake,Garden,Riga,6,99,2025-04-30
6,K3,Lamp,Home,Riga,1,50,2025-05-11
7,K9,Kettle,Kitchen,Lisbon,5,201,2025-06-05
8,K5,Spade,Garden,Lisbon,2,90,2025-06-17
9,K6,Lamp,Home,Oslo,2,100,2025-07-08
10,K8,Rake,Garden,Oslo,5,49.5,2025-07-21
11,K2,Kettle,Kitchen,Riga,10,405,2025-08-03
12,K4,Spade,Garden,Oslo,4,180,2025-08-09
13,K1,Lamp,Home,Lisbon,3,150,2025-08-27
"""


@pytest.fixture(scope="session")
def samples(tmp_path_factory):
    folder = tmp_path_factory.mktemp("samples")
    texts = {
        "employees": EMPLOYEES,
        "products": PRODUCTS,
        "customers": CUSTOMERS,
        "sales": DATED_SALES,
    }
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return {name: str(folder / f"{name}.csv") for name in texts}


@pytest.fixture(scope="session")
def read(spark, samples):
    from orefold.sources.csv import read_strings

    return lambda name: read_strings(spark, samples[name])


def by(rows, key):
    return {row[key]: row for row in rows}
