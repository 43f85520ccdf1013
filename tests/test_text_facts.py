from routeloom.functions import go_facts, js_facts, rails_facts, spring_facts


def routes(extract, text, path="x"):
    return {(f["route"], f["method"]) for f in extract(text, path) if f["what"] == "endpoint"}


def test_express():
    text = """
// app.get('/comment', h)
const router = express.Router();
router.get('/users/:id', auth, (req, res) => { res.send(")") });
router.route('/books').get(list).post(add);
app.get('setting');
httpClient.get('/away', cb);
app.post(`/t/${x}`, h);
"""
    assert routes(js_facts.extract, text) == {("/users/:id", "GET"), ("/books", "GET"), ("/books", "POST")}
    assert any(f["what"] == "reject" for f in js_facts.extract(text, "x"))


def test_nest():
    text = "@Controller('cats')\nexport class CatsController {\n  @Get()\n  all() {}\n  @Post(':id/feed')\n  feed(@Param('id') id: string) {}\n}\n"
    assert routes(js_facts.extract, text) == {("/cats", "GET"), ("/cats/:id/feed", "POST")}


def test_spring():
    text = """
package a.b;
@RestController
@RequestMapping({"/v1", "/v2"})
public class PetController implements PetApi {
  static final String P = "/pets";
  @GetMapping(P + "/{id}")
  public Pet get(@PathVariable String id) { return null; }
  @RequestMapping(value = "/any")
  public Pet any() { return null; }
  @PostMapping(path = unknown())
  public void bad() {}
  @PutMapping(value = "/x", consumes = "application/json")
  public void put(String a, int b) {}
}
@FeignClient("f")
interface Away { @GetMapping("/away") String away(); }
"""
    assert routes(spring_facts.extract, text) == {(p + q, v) for p in ("/v1", "/v2") for q, v in (("/pets/{id}", "GET"), ("/any", "GET"), ("/x", "PUT"))}
    rejects = [f["detail"] for f in spring_facts.extract(text, "x") if f["what"] == "reject"]
    assert "unreadable mapping" in rejects and "no method named: GET" in rejects


def test_go():
    text = """
package main
func routes(r *gin.Engine) {
  // r.GET("/comment", h)
  api := r.Group("/api")
  v1 := api.Group("/v1")
  v1.GET("/users/:id", getUser)
  r.Any("/any", h)
  mux.HandleFunc("GET /plain", plain)
  mux.HandleFunc("/old", old)
  m.HandleFunc("/posts", posts).Methods("POST", "PUT")
  r.Route("/chi", func(r chi.Router) { r.Get("/in", in) })
}
"""
    got = routes(go_facts.extract, text)
    assert {("/api/v1/users/:id", "GET"), ("/plain", "GET"), ("/old", "GET"), ("/posts", "POST"), ("/posts", "PUT"), ("/chi/in", "GET")} <= got
    assert {v for p, v in got if p == "/any"} == set(go_facts.VERBS) and len(got) == 13


def test_rails():
    text = """
Rails.application.routes.draw do
  root to: "home#index"
  concern :likeable do
    post :like
  end
  namespace :api do
    resources :posts, only: [:index, :show], concerns: :likeable do
      member do
        get :preview
      end
      collection { }
      resources :comments, only: %i[create]
    end
  end
  resource :profile, except: [:destroy, :new, :edit]
  get "/about" => "pages#about"   # a remark
  match "/both", to: "pages#both", via: [:get, :post]
end
"""
    got = {(f["method"], f["route"], f["target"]) for f in rails_facts.extract(text, "config/routes.rb") if f["what"] == "endpoint"}
    assert {("GET", "/", "home#index"), ("GET", "/api/posts", "api/posts#index"), ("GET", "/api/posts/:id", "api/posts#show"), ("GET", "/api/posts/:id/preview", "api/posts#preview"), ("POST", "/api/posts/:post_id/comments", "api/comments#create"), ("GET", "/about", "pages#about"), ("GET", "/both", "pages#both"), ("POST", "/both", "pages#both"), ("PUT", "/profile", "profiles#update")} <= got
    assert ("POST", "/api/posts/:post_id/like", "api/posts#like") in got


def test_ruby_classes():
    text = "class A::UsersController < ApplicationController\n  include Auth, Log\n  def index\n    x do\n    end\n  end\n  def self.make; end\n  private\n  def secret\n  end\nend\n"
    got = list(rails_facts.extract(text, "app/controllers/users_controller.rb"))
    assert [(f["name"], f["kind"]) for f in got if f["what"] == "ruby_method"] == [("index", "instance"), ("make", "singleton"), ("secret", "private")]


def test_gradle_assignments():
    """The first string given to a name, by a sign or a setter; comparisons and loose strings are none."""
    from routeloom.functions import contract_facts as cf

    block = "generatorName = \"spring\"\ninputSpec.set('$rootDir/a.json')\nx == \"no\"\ny != 'n'\nz += \"q\"\n  apiPackage=\n \"p.q\"; generatorName = \"late\"; w.set( \"it's\" ) \"loose\""
    assert cf.told(block) == {"generatorName": "spring", "inputSpec": "$rootDir/a.json", "apiPackage": "p.q", "w": "it's"}
    assert [(e["generator"], e["spec"]) for e in cf.gradle("a {\n // generatorName = \"go\"\n generatorName = 'spring'\n inputSpec = \"$rootDir/s.json\"\n}\nb { inputSpec = \"x\" }\n", "m")] == [("spring", "s.json")]
    assert cf.told("") == {} and cf.told("'x'") == {} and cf.told("= 'x'") == {}
