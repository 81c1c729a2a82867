"""A small service as an inline tree, clean and with one broken file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLEAN = {
    ".env.example": "DATABASE_URL=\nexport API_KEY=\n# comment\nREDIS_URL: x\nSMTP_HOST=\n",
    ".env": "PRIVATE_KEY=do-not-index\n",
    "requirements.txt": "fastapi==0.1\nuvicorn[standard]==0.2\nrequests==2.0\nPyYAML==6.0\nsqlalchemy==2.0\n",
    "Dockerfile": "FROM scratch\nENV WORKERS=8 STAGE=prod\n",
    "docker-compose.yml": "services:\n  web:\n    environment:\n      - QUEUE_URL=x\n      CACHE_URL: y\n    ports:\n      - 80\n",
    "app/__init__.py": "",
    "app/config.py": 'import os\n\nimport yaml\n\nURL = os.environ["DATABASE_URL"]\nKEY = os.getenv("API_KEY")\nCACHE = os.environ.get("REDIS_URL")\nLEVEL = os.getenv("LOG_LEVEL", "info")\nSCHEMA = yaml.safe_load("{}")\n',
    "app/handlers.py": "import requests\n\n\ndef health():\n    return 1\n\n\ndef metrics():\n    return requests.__version__\n",
    "app/users.py": 'from fastapi import APIRouter\n\nrouter = APIRouter(prefix="/users")\n\n\n@router.get("/{user_id}")\ndef get_user(user_id):\n    return user_id\n\n\n@router.post("")\ndef create_user():\n    return 1\n',
    "app/orders.py": 'from fastapi import APIRouter\n\nrouter = APIRouter()\n\n\n@router.post("/orders")\ndef create_order():\n    return 1\n\n\n@router.get("/orders/{order_id}")\ndef get_order(order_id):\n    return order_id\n',
    "app/main.py": (
        "from fastapi import FastAPI\n\nfrom app import orders, users\nfrom app.handlers import health, metrics\n\napp = FastAPI()\n"
        'app.include_router(users.router, prefix="/api")\napp.include_router(orders.router, prefix="/api")\n'
        'app.add_api_route("/health", health)\napp.add_api_route("/metrics", metrics, methods=["GET", "HEAD"])\n\n\n@app.get("/")\ndef index():\n    return 1\n'
    ),
    "app/tasks.py": 'import os\n\nimport sqlalchemy\n\nHOST = os.environ["SMTP_HOST"]\nENGINE = sqlalchemy.create_engine(os.environ["DATABASE_URL"])\n',
}
BROKEN = {"app/broken.py": 'import os\n\nimport requestz\nfrom app.handlers import health\nfrom app.main import app\n\nX = os.environ["DATABSE_URL"]\napp.add_api_route("/late", helth)\n'}
DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,3 @@\n one\n+two\n-three\n+four\n\\ No newline at end of file\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\ndiff --git a/old.py b/new.py\nrename from old.py\nrename to new.py\n@@ -0,0 +1 @@\n+renamed\n"


def tree(spark: SparkSession, broken: bool = False) -> DataFrame:
    return spark.createDataFrame(list((CLEAN | (BROKEN if broken else {})).items()), "path string, text string")
