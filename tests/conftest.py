from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.options import DatasetOptions  # noqa: E402
from tidemark.session import build_session  # noqa: E402

YES_NO = ("Partner", "Dependents", "PhoneService", "OnlineSecurity", "OnlineBackup",
          "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling")
CATEGORICAL = ("gender", "SeniorCitizen", *YES_NO, "MultipleLines", "InternetService", "Contract",
               "PaymentMethod")
NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "tests", "local[8]", 8,
        **{"spark.checkpoint.dir": shared, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def churn_rows() -> list[dict]:
    """24 customers, half of them leaving; one has a blank total."""
    rng = random.Random(7)
    rows = []
    for i in range(24):
        leaving = i % 2 == 0
        tenure = rng.randint(1, 12) if leaving else rng.randint(20, 72)
        monthly = round(rng.uniform(30, 110), 2)
        row = {"customerID": f"{i:04d}-ABCDE", "gender": rng.choice(["Female", "Male"]),
               "SeniorCitizen": rng.randint(0, 1), "tenure": tenure}
        row |= {name: rng.choice(["Yes", "No"]) for name in YES_NO}
        row |= {
            "MultipleLines": rng.choice(["Yes", "No", "No phone service"]),
            "InternetService": rng.choice(["DSL", "Fiber optic"]),
            "Contract": "Month-to-month" if leaving else rng.choice(["One year", "Two year"]),
            "PaymentMethod": rng.choice(["Electronic check", "Mailed check"]),
            "MonthlyCharges": monthly,
            "TotalCharges": " " if i == 0 else f"{tenure * monthly:.2f}",
            "Churn": "Yes" if leaving else "No",
        }
        rows.append(row)
    return rows


@pytest.fixture(scope="session")
def churn_options() -> DatasetOptions:
    return DatasetOptions(
        target="Churn", positive_class="Yes", id_columns=("customerID",),
        required_columns=("customerID", "tenure", "Churn"), numeric_features=NUMERIC,
        categorical_features=CATEGORICAL, numeric_coercion_columns=("TotalCharges",),
        na_values=("", " "),
    )


@pytest.fixture(scope="session")
def churn(spark, churn_rows):
    return spark.createDataFrame(churn_rows).select(*churn_rows[0]).cache()


@pytest.fixture(scope="session")
def churn_csv(churn_rows, tmp_path_factory) -> str:
    import csv

    path = tmp_path_factory.mktemp("csv") / "churn.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        writer = csv.DictWriter(f, list(churn_rows[0]))
        writer.writeheader()
        writer.writerows(churn_rows)
    return str(path)
