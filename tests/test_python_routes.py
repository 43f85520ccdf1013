from routeloom.plans.python_routes import python_endpoints

FLASK = """
from flask import Blueprint
bp = Blueprint("users", __name__, url_prefix="/old")
@bp.route("/users/<int:id>", methods=["GET", "POST"])
def user(id): pass
@bp.route("/plain")
def plain(): pass
"""
APP = """
from fastapi import FastAPI
from pkg.api.users import bp
from .api.items import router as items
app = FastAPI()
app.register_blueprint(bp, url_prefix="/new")
app.include_router(items, prefix="/v1")
@app.get("/health")
async def health(): pass
class Thing(APIView):
    def get(self): pass
    def helper(self): pass
"""
ITEMS = """
from fastapi import APIRouter
router = APIRouter(prefix="/items")
@router.delete("/{item}")
def drop(item): pass
"""
URLS = """
from django.urls import path, include, re_path
from rest_framework.routers import DefaultRouter
from shop import views
from shop.views import OrderSet
router = DefaultRouter()
router.register("orders", OrderSet)
urlpatterns = [path("shop/", include("shop.urls")), path("api/", include(router.urls)), re_path(r"^raw/(?P<slug>[a-z]+)/$", views.raw), re_path(r"^(a|b)/$", views.raw)]
def f():
    urlpatterns = [path("never/", views.raw)]
"""
SHOP_URLS = """
from django.urls import path
from . import views
from .views import Cart
urlpatterns = [path("list/", views.listing)]
urlpatterns += [path("cart/<int:pk>/", Cart.as_view())]
"""
VIEWS = """
from rest_framework.decorators import api_view
@api_view(["GET", "PUT"])
def listing(request): pass
def raw(request): pass
class Cart(View):
    def get(self): pass
    def post(self): pass
class OrderSet(ReadOnlyModelViewSet):
    def destroy(self): pass
"""


def found(spark, files):
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, rel_path string, text string")
    return {(r.route, r.method) for r in python_endpoints(df).collect()}


def test_prefixes(spark):
    got = found(spark, {"pkg/api/users.py": FLASK, "pkg/app.py": APP, "pkg/api/items.py": ITEMS, "broken.py": "def ("})
    assert got == {("/new/users/{id}", "GET"), ("/new/users/{id}", "POST"), ("/new/plain", "GET"), ("/health", "GET"), ("/v1/items/{item}", "DELETE"), (None, "GET")}


def test_django(spark):
    got = found(spark, {"site/urls.py": URLS, "shop/urls.py": SHOP_URLS, "shop/views.py": VIEWS, "shop/__init__.py": ""})
    got = {g for g in got if g[0]}
    assert got == {("/shop/list/", "GET"), ("/shop/list/", "PUT"), ("/shop/cart/{pk}/", "GET"), ("/shop/cart/{pk}/", "POST"), ("/raw/{slug}/", "GET"), ("/api/orders/", "GET"), ("/api/orders/{pk}/", "GET"), ("/api/orders/{pk}/", "DELETE")}
