"""Words that mark where data enters, where it does harm, and what makes it harmless.

They are matched as case-sensitive substrings of a line, in the order given here: of several flows
from one source the first in this order is the one that is kept.
"""

from __future__ import annotations


def _words(text: str) -> list[str]:
    """Entries are separated by a bar, since some of them end in a space."""
    return [w for w in text.strip("\n").replace("\n", " | ").split(" | ") if w]


# Sources by language.
SOURCES = {
    "python": _words("request.args | request.form | request.json | request.data | request.files | request.cookies | request.headers | request.get_json | request.values | request.POST | request.GET | request.META | Body( | Query( | Path( | Form( | input( | sys.stdin | os.environ | environ.get | os.getenv | getattr(request"),
    "javascript": _words("req.body | req.query | req.params | req.headers | req.cookies | request.body | request.query | request.params | document.URL | document.location | window.location | document.referrer | location.href | location.search | location.hash | document.cookie | event.data | postMessage | localStorage.getItem | sessionStorage.getItem | new URLSearchParams | decodeURIComponent | JSON.parse(req | ctx.query | ctx.request.body"),
    "java": _words("request.getParameter | request.getQueryString | request.getHeader | request.getCookies | request.getInputStream | request.getReader | System.getenv | System.getProperty | request.getAttribute | getServletPath"),
    "php": _words("$_GET | $_POST | $_REQUEST | $_SERVER | $_COOKIE | $_FILES | $_ENV | getallheaders( | apache_request_headers( | file_get_contents('php://input')"),
    "go": _words("r.URL.Query() | r.FormValue( | r.PostFormValue( | r.Header.Get( | r.Body | r.Cookie( | chi.URLParam( | mux.Vars( | c.Query( | c.Param( | c.PostForm( | ctx.QueryParam( | ctx.FormValue("),
}

# Sinks by language and kind of flaw.
SINKS = {
    "python": {
        "sql_injection": _words("execute( | executemany( | raw( | RawSQL( | cursor.execute( | db.execute( | session.execute( | engine.execute( | text( | query.format( | .filter( | extra( | RawSQL("),
        "command_injection": _words("os.system( | subprocess.call( | subprocess.run( | subprocess.Popen( | subprocess.check_output( | os.popen( | commands.getoutput( | eval( | exec( | execfile("),
        "xss": _words("render_template_string( | Markup( | mark_safe( | format_html( | innerHTML | .write( | Response( | HTMLParser( | jinja2.Template("),
        "ssrf": _words("requests.get( | requests.post( | requests.put( | urllib.request.urlopen( | urllib.urlopen( | httpx.get( | httpx.post( | aiohttp.ClientSession( | urllib3.PoolManager( | pycurl.Curl("),
        "path_traversal": _words("open( | os.path.join( | os.listdir( | os.remove( | shutil.copy( | pathlib.Path( | send_file( | send_from_directory( | FileResponse("),
        "ssti": _words("render_template_string( | Template( | from_string( | Environment().from_string( | jinja2.Template("),
        "deserialization": _words("pickle.loads( | pickle.load( | yaml.load( | marshal.loads( | jsonpickle.decode("),
        "ldap_injection": _words("ldap.search( | ldap3.Connection("),
        "xxe": _words("lxml.etree.fromstring( | xml.etree.ElementTree.parse( | xmltodict.parse( | minidom.parseString("),
    },
    "javascript": {
        "sql_injection": _words("query( | execute( | .raw( | db.query( | pool.query( | connection.query( | knex.raw( | sequelize.query("),
        "xss": _words("innerHTML | outerHTML | document.write( | insertAdjacentHTML( | eval( | setTimeout( | setInterval( | Function( | dangerouslySetInnerHTML | v-html | $( | .html("),
        "command_injection": _words("child_process.exec( | exec( | execSync( | spawn( | spawnSync( | execFile( | shelljs.exec( | cp.exec("),
        "ssrf": _words("fetch( | axios.get( | axios.post( | http.request( | https.request( | got( | superagent.get( | needle.get( | request("),
        "path_traversal": _words("fs.readFile( | fs.writeFile( | fs.readFileSync( | res.sendFile( | path.join( | fs.existsSync("),
        "nosql_injection": _words(".find( | .findOne( | .aggregate( | .update( | .findOneAndUpdate( | mongoose.model("),
        "prototype_pollution": _words("Object.assign( | _.merge( | _.extend( | merge( | extend( | deepMerge("),
    },
    "java": {
        "sql_injection": _words("createQuery( | createNativeQuery( | executeQuery( | prepareStatement( | Statement.execute( | EntityManager.createNativeQuery("),
        "command_injection": _words("Runtime.exec( | ProcessBuilder( | new ProcessBuilder("),
        "xss": _words("PrintWriter.write( | getOutputStream().write( | response.getWriter( | out.println("),
        "path_traversal": _words("new File( | new FileInputStream( | new FileOutputStream( | Paths.get( | Files.readAllBytes("),
        "xxe": _words("DocumentBuilder.parse( | SAXParser.parse( | XMLReader.parse( | XMLInputFactory("),
        "ssrf": _words("new URL( | HttpURLConnection( | URL.openConnection( | HttpClient.newHttpClient( | RestTemplate("),
    },
    "php": {
        "sql_injection": _words("mysql_query( | mysqli_query( | $pdo->query( | pg_query( | sqlite_query("),
        "command_injection": _words("system( | exec( | shell_exec( | passthru( | popen( | proc_open( | eval("),
        "xss": _words("echo  | print( | printf( | <?= | var_dump("),
        "path_traversal": _words("include( | require( | include_once( | require_once( | file_get_contents( | fopen( | readfile("),
        "ssrf": _words("curl_exec( | file_get_contents( | fopen('http"),
        "xxe": _words("simplexml_load_string( | simplexml_load_file( | DOMDocument->loadXML( | xml_parse("),
    },
    "go": {
        "sql_injection": _words("db.Query( | db.Exec( | db.QueryRow( | stmt.Query( | gorm.Raw("),
        "command_injection": _words("exec.Command( | os/exec.Command("),
        "ssrf": _words("http.Get( | http.Post( | http.NewRequest( | http.DefaultClient.Do( | resty.New("),
        "path_traversal": _words("os.Open( | ioutil.ReadFile( | os.ReadFile( | http.ServeFile( | filepath.Join("),
    },
}

# Sanitizers by language.
SANITIZERS = {
    "python": _words("escape( | html.escape( | bleach.clean( | markupsafe.escape( | parameterized | prepared_statement | re.escape( | shlex.quote( | pipes.quote( | validate( | sanitize( | clean( | strip( | int( | float( | bool( | uuid.UUID( | datetime.fromisoformat("),
    "javascript": _words("sanitize( | DOMPurify.sanitize( | xss( | escape( | encodeURIComponent( | encodeURI( | validator.escape( | validator.isURL( | validator.isEmail( | parameterize( | parseInt( | parseFloat( | Number( | Boolean( | String("),
    "java": _words("StringEscapeUtils.escapeHtml( | ESAPI.encoder().encodeForHTML( | PreparedStatement | HtmlUtils.htmlEscape( | Integer.parseInt( | Long.parseLong( | UUID.fromString("),
    "php": _words("htmlspecialchars( | htmlentities( | strip_tags( | addslashes( | mysqli_real_escape_string( | filter_var( | intval( | floatval( | preg_replace( | PDO::prepare("),
    "go": _words("html.EscapeString( | url.QueryEscape( | template.HTMLEscapeString( | strconv.Atoi( | strconv.ParseInt( | uuid.Parse( | regexp.MustCompile("),
}

#: What may stand between the begin of a line and the variable that it assigns, by language.
BEFORE_NAME = {
    "python": r"[ \t]*",
    "javascript": r"(?:(?:const|let|var)[ \t]+|[ \t]*)",
    "java": r"(?:\w+[ \t]+)?",
    "php": r"\$",
    "go": r"(?:var[ \t]+)?",
}
#: The assigned variable at the start of a line, in the first group.
ASSIGNED = {language: rf"^{before}(\w+)[ \t]*{':?=' if language == 'go' else '='}" for language, before in BEFORE_NAME.items()}

# What a kind of flaw is called in findings: category, CWE, OWASP, severity.
FLAWS = {
    "sql_injection": ("injection", "CWE-89", "A03:2021", "HIGH"),
    "command_injection": ("injection", "CWE-78", "A03:2021", "CRITICAL"),
    "xss": ("xss", "CWE-79", "A03:2021", "HIGH"),
    "ssrf": ("ssrf", "CWE-918", "A10:2021", "HIGH"),
    "path_traversal": ("path_traversal", "CWE-22", "A01:2021", "HIGH"),
    "ssti": ("ssti", "CWE-94", "A03:2021", "CRITICAL"),
    "deserialization": ("injection", "CWE-502", "A08:2021", "CRITICAL"),
    "ldap_injection": ("injection", "CWE-90", "A03:2021", "HIGH"),
    "xxe": ("xxe", "CWE-611", "A05:2021", "HIGH"),
    "nosql_injection": ("injection", "CWE-943", "A03:2021", "HIGH"),
    "prototype_pollution": ("injection", "CWE-1321", "A03:2021", "MEDIUM"),
}
LOOK_AHEAD = 99
TRACED, DIRECT = 0.75, 0.9


def sink_rows(language: str) -> list[tuple[int, str, int, str]]:
    """(flaw order, flaw, pattern order, pattern) of a language's sinks."""
    return [(i, flaw, j, p) for i, (flaw, patterns) in enumerate(SINKS.get(language, {}).items()) for j, p in enumerate(patterns)]
