"""The values that the SQL of the queries goes by, written out apart from the operators' own, so that a wrong entry shows."""

# fixed values
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.tr", "org.tr", "net.tr", "gov.tr", "edu.tr", "bel.tr", "k12.tr", "av.tr", "com.au",
    "net.au", "org.au", "gov.au", "edu.au", "com.br", "com.cn", "com.mx", "com.ar", "com.sg", "com.hk", "com.tw", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "go.jp", "co.kr", "or.kr", "go.kr", "co.in", "net.in", "org.in", "gov.in", "ac.in", "co.za", "org.za", "gov.za", "co.nz", "net.nz", "govt.nz",
    "com.es", "gob.es", "com.pl", "gov.pl", "com.ua", "gov.ua", "com.sa", "gov.sa", "com.eg", "gov.eg", "com.my", "gov.my",
]
BINARY = [
    "png", "jpg", "jpeg", "gif", "webp", "avif", "bmp", "ico", "svg", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "ogg", "wav",
    "pdf", "zip", "gz", "br", "wasm",
]
ANALYSABLE = [
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "map", "json", "geojson", "topojson", "css", "xml", "yaml", "yml", "txt", "webmanifest",
]
PAGES = [
    "", "html", "htm", "php", "asp", "aspx", "jsp", "do", "action",
]
INFRASTRUCTURE = [
    "/cdn-cgi/", "/_incapsula_resource", "/_sucuri/", "/akam/", "/_vercel/insights", "/_vercel/speed-insights", "/__nextjs_original-stack-frame",
    "/.well-known/traffic-advice",
]
SWAGGER = [
    "swagger.json", "swagger.yaml", "swagger.yml", "openapi.json", "openapi.yaml", "openapi.yml", "/swagger-ui", "/swagger/", "/api-docs",
    "/apidocs", "/redoc", "/v2/api-docs", "/v3/api-docs", "/openapi",
]
GRAPHQL = [
    "/graphql", "/graphiql", "/gql", "/altair", "/playground", "/subscriptions",
]
ARCGIS = [
    "/mapserver", "/featureserver", "/sceneserver", "/geometryserver", "/gpserver", "/geocodeserver", "/geodataserver", "/globeserver",
    "/streamserver", "/arcgis/rest/",
]
OGC = [
    "/geoserver", "/ows", "/wms", "/wmts", "/wfs", "/wcs", "/mapserv", "/qgis",
]
TILES = [
    "{z}", "{x}", "{y}", "{-y}", "/tiles/", "/tile/", ".pbf", ".mvt", "/wmts",
]
AUTH = [
    "login", "signin", "sign-in", "logout", "signout", "register", "signup", "oauth", "oauth2", "token", "authorize", "auth", "sso", "saml",
    "session", "password", "forgot", "reset", "verify", "otp", "mfa", "2fa", "refresh", "identity", "jwt", "openid-configuration", "connect",
]
STREAMS = [
    "sse", "stream", "streams", "eventsource", "event-stream", "livestream",
]
REST = [
    "/api/", "/api?", "/apis/", "/rest/", "/restapi", "/services/", "/service/", "/rpc/", "/ajax/", "/query", "/graph/", "/gateway/", "/backend/",
    "/data/",
]
MUTATING = [
    "create", "update", "delete", "remove", "insert", "add", "save", "submit", "upload", "edit", "modify", "post", "put", "patch", "send", "apply",
]
INTEREST = {
    "GraphQL": 100, "Swagger/OpenAPI": 95, "Authentication": 90, "REST": 85, "ArcGIS REST": 80, "GeoServer": 78, "Image Service": 70, "WebSocket": 68,
    "SOAP": 60, "Stream/SSE": 58, "Tile Server": 40, "Static JSON": 30, "Unknown": 10,
}
