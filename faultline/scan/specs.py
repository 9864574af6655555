"""What library calls do, as rows: sources, sinks, sanitizers, allocators and the like, by language.

The tables are written in groups, `role kind [arguments]: names`, with {a,b} standing for either; rows() spells them out. Rows of a
later table replace earlier ones of that name and role, so users add or change rows by passing their own (add_rows, read_rows).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: The weakness type that a sink kind is reported as; others are taint_flow.
SINK_TYPES = {
    "sql": "sql_injection",
    "html": "xss",
    "xss": "xss",
    "shell": "command_injection",
    "command": "command_injection",
    "ldap": "ldap_injection",
    "xpath": "xpath_injection",
    "xml_injection": "xml_injection",
    "eval": "code_injection",
    "template": "template_injection",
    "nosql": "nosql_injection",
    "xml": "xxe",
    "regex": "regex_dos",
    "orm": "orm_injection",
    "el": "el_injection",
    "filesystem": "path_traversal",
    "redirect": "open_redirect",
    "ssrf": "ssrf",
    "authz": "authorization_bypass",
    "resource_select": "idor",
    "cors": "cors_misconfiguration",
    "alloc_size": "unbounded_allocation",
    "header": "header_injection",
    "secret": "secret_exposure",
    "debug": "debug_enabled",
    "weak_crypto": "weak_crypto",
    "hardcoded_secret": "hardcoded_secret",
    "insecure_random": "insecure_random",
    "weak_hash": "weak_hash",
    "insecure_temp_file": "insecure_temp_file",
    "cert_validation": "improper_cert_validation",
    "weak_key_size": "insufficient_key_size",
    "credential": "broken_authentication",
    "session": "session_fixation",
    "trust_boundary": "trust_boundary_violation",
    "insecure_cookie": "insecure_cookie",
    "insecure_cookie_httponly": "insecure_cookie_httponly",
    "deserialize": "deserialization",
    "csrf_disabled": "csrf",
    "log": "log_injection",
    "error_disclosure": "error_disclosure",
    "format_string": "format_string",
    "buffer_overflow": "buffer_overflow",
    "integer_overflow": "integer_overflow",
    "dangerous_function": "dangerous_function",
    "mass_assignment": "mass_assignment",
    "prototype": "prototype_pollution",
    "index": "oob_read",
}

TABLES = {
    "python": """
source user: input raw_input flask.request.{args,form,values,cookies,headers,json,data,files,get_json,get_data,query_string,path,url}
source user: request.{args,form,values,cookies,headers,json,data,files,get_json,get_data,GET,POST,COOKIES,META,FILES,body,query_params,query_string,match_info}
source user: self.get_{argument,arguments,body_argument,query_argument,cookie} sys.argv sys.stdin.{read,readline,readlines} sys.stdin bottle.request.{query,forms,params}
source env: os.getenv os.environ os.environ.get
source network: socket.recv recv recvfrom requests.get.text urllib.request.urlopen.read
sink shell 0: os.{system,popen,popen2,popen3} subprocess.{run,call,Popen,check_call,check_output,getoutput,getstatusoutput} commands.{getoutput,getstatusoutput} pty.spawn asyncio.{create_subprocess_shell,create_subprocess_exec} os.{execl,execv,execve,execvp,spawnl,spawnv} paramiko.exec_command exec_command
sink eval 0: eval exec compile builtins.{eval,exec} code.interact importlib.import_module __import__
sink sql 0: {cursor,cur,c,conn,connection,db,database,session,engine}.{execute,executemany,executescript} execute executemany executescript sqlalchemy.text django.db.connection.execute objects.{raw,extra} RawSQL
sink filesystem 0: open io.open codecs.open os.{remove,unlink,rmdir,mkdir,makedirs,listdir,rename,chdir,stat} shutil.{copy,copyfile,move,rmtree} flask.send_file send_file pathlib.Path.{read_text,write_text} zipfile.ZipFile tarfile.open
sink filesystem 1: flask.send_from_directory send_from_directory
sink html 0: flask.{Markup,make_response} markupsafe.Markup django.http.HttpResponse HttpResponse HTMLResponse django.utils.safestring.mark_safe mark_safe self.write self.finish Markup make_response
sink template 0: flask.render_template_string render_template_string jinja2.Template jinja2.Environment.from_string from_string mako.template.Template Template
sink ssrf 0: requests.{get,post,put,delete,head,patch,options} urllib.request.{urlopen,urlretrieve,Request} urllib2.urlopen httpx.{get,post,put,delete,head,patch,stream} aiohttp.ClientSession.get urllib3.PoolManager.request
sink ssrf 1: requests.request httpx.request
sink deserialize 0: pickle.{loads,load,Unpickler} cPickle.{loads,load} yaml.{load,unsafe_load,full_load,load_all} marshal.{loads,load} jsonpickle.decode dill.{loads,load} shelve.open
sink redirect 0: flask.redirect django.shortcuts.redirect django.http.HttpResponseRedirect redirect HttpResponseRedirect RedirectResponse self.redirect
sink xml 0: lxml.etree.{fromstring,parse,XML} xml.etree.ElementTree.{fromstring,parse,XML} xml.dom.minidom.{parse,parseString} xml.sax.{parse,parseString} etree.{fromstring,parse,XML} ET.{fromstring,parse}
sink xpath 0: xpath find_xpath lxml.etree.XPath
sink ldap 2: search_s search_ext_s ldap.search
sink ldap 1: ldap3.Connection.search
sink nosql 0: {collection,coll,users,db}.{find,find_one,aggregate,update_one,delete_one} find_one
sink regex 0: re.{compile,match,search,fullmatch,sub,findall,split}
sink log 0: logging.{info,debug,warning,error,critical} logger.{info,debug,warning,error,critical} app.logger.{info,error,warning,debug}
sink header 1: response.headers.set headers.add
sink alloc_size 0: bytearray numpy.{zeros,empty,ones}
usage weak_hash: hashlib.{md5,sha1,md4} Crypto.Hash.{MD5,SHA,MD4,MD2}.new md5.new sha.new
usage insecure_random: random.{random,randint,choice,randrange,uniform,getrandbits,sample,shuffle}
usage insecure_temp_file: tempfile.mktemp os.{tempnam,tmpnam}
usage weak_crypto: Crypto.Cipher.{DES,ARC4,ARC2,Blowfish,DES3}.new DES.new ARC4.new
usage cert_validation: ssl._create_unverified_context
sanitizer shell: shlex.quote pipes.quote
sanitizer html: html.escape cgi.escape markupsafe.escape flask.escape django.utils.html.escape bleach.clean escape conditional_escape
sanitizer filesystem: os.path.basename werkzeug.utils.secure_filename secure_filename
sanitizer sql: {mysql.connector,MySQLdb,psycopg2.extensions}.{escape_string,quote_ident} escape_string
sanitizer regex: re.escape
sanitizer redirect,ssrf: url_has_allowed_host_and_scheme urllib.parse.quote
sanitizer ldap: ldap.filter.escape_filter_chars escape_filter_chars
sanitizer log: repr json.dumps
sanitizer *: int float bool len hash abs round ord uuid.UUID hashlib.{sha256,sha512} isinstance isdigit isalnum isnumeric hmac.compare_digest
mode 1: os.chmod os.fchmod pathlib.Path.chmod
mode 0: os.umask
""",
    "javascript": """
source user: req.{query,body,params,cookies,headers,url,originalUrl,path,hostname,files} request.{query,body,params,cookies,headers,url} ctx.{query,params,request,body} ctx.request.{query,body} event.{queryStringParameters,body,pathParameters,headers}
source user: {document,window}.location location.{hash,search,href,pathname} window.name document.{cookie,referrer,URL,documentURI} URLSearchParams.get prompt readline.question process.argv
source env: process.env
sink shell 0: child_process.{exec,execSync,spawn,spawnSync,execFile,execFileSync,fork} exec execSync spawn spawnSync execFile shell.exec shelljs.exec execa execaCommand
sink eval 0: eval Function setTimeout setInterval vm.{runInContext,runInNewContext,runInThisContext} vm.Script setImmediate
sink sql 0: {db,connection,conn,pool,client,knex,sequelize,mysql,pg}.{query,execute,raw,all,run,get,each} sequelize.query knex.raw query
sink nosql 0: {collection,coll,db,User,users,Model}.{find,findOne,findOneAndUpdate,aggregate,deleteMany,updateOne} $where
sink html 0: res.{send,write,end} response.{send,write,end} document.{write,writeln} insertAdjacentHTML {$,jQuery}().{html,append,prepend,after,before} ctx.body
sink filesystem 0: fs.{readFile,readFileSync,writeFile,writeFileSync,createReadStream,createWriteStream,unlink,unlinkSync,readdir,readdirSync,mkdir,rmdir,stat,access,appendFile} fs.promises.{readFile,writeFile} res.{sendFile,download} readFile readFileSync createReadStream require
sink ssrf 0: axios axios.{get,post,put,delete,head,patch,request} fetch request request.{get,post} got needle http.{get,request} https.{get,request} superagent.get
sink redirect 0: res.redirect response.redirect ctx.redirect window.location.{assign,replace} location.{assign,replace} window.open
sink deserialize 0: unserialize serialize.unserialize node-serialize.unserialize yaml.load jsyaml.load v8.deserialize
sink template 0: ejs.render pug.{compile,render} handlebars.compile Handlebars.compile _.template nunjucks.renderString mustache.render
sink xml 0: libxmljs.{parseXml,parseXmlString} xml2js.parseString DOMParser.parseFromString
sink regex 0: RegExp
sink log 0: console.{log,error,warn,info} logger.{info,error,warn,debug}
sink header 1: res.{setHeader,set,header} response.setHeader
sink mass_assignment 1: Object.assign
sink prototype 1: _.{merge,defaultsDeep,set,setWith} lodash.{merge,defaultsDeep,set} $.extend jQuery.extend
sink ldap 1: client.search ldap.search
sink xpath 0: xpath.{select,evaluate} document.evaluate
usage weak_hash: crypto.createHash:md5 crypto.createHash:sha1
usage insecure_random: Math.random crypto.pseudoRandomBytes
usage weak_crypto: crypto.createCipher crypto.createDecipher
sanitizer html: encodeURIComponent escapeHtml he.{encode,escape} DOMPurify.sanitize validator.escape sanitizeHtml sanitize-html xss _.escape lodash.escape
sanitizer redirect,ssrf: encodeURIComponent encodeURI
sanitizer shell: shellescape shell-quote.quote shellQuote.quote
sanitizer filesystem: path.basename sanitize-filename sanitizeFilename
sanitizer sql: mysql.escape connection.escape pool.escape SqlString.escape sqlstring.escape escapeId
sanitizer regex: escapeRegExp _.escapeRegExp escapeStringRegexp
sanitizer *: parseInt parseFloat Number Boolean isNaN Number.{parseInt,parseFloat} Math.{floor,ceil,round,abs,min,max} typeof hasOwnProperty
""",
    "java": """
source user: {request,req,httpRequest,httpServletRequest}.{getParameter,getParameterValues,getParameterMap,getHeader,getHeaders,getCookies,getQueryString,getInputStream,getReader,getRequestURI,getRequestURL,getPathInfo,getPart,getParts,getParameterNames,getHeaderNames} getParameter getParameterValues getTheParameter getTheValue getQueryString getTheCookie
source user: Scanner.{nextLine,next} scanner.{nextLine,next} BufferedReader.readLine readLine Cookie.getValue cookie.getValue theCookie.getValue
source env: System.{getenv,getProperty}
source database: ResultSet.getString rs.getString resultSet.getString
sink sql 0: {Statement,statement,stmt,st,s}.{executeQuery,executeUpdate,execute,addBatch,executeLargeUpdate} executeQuery executeUpdate {Connection,connection,conn,con}.{prepareStatement,prepareCall,nativeSQL} prepareStatement prepareCall {jdbcTemplate,JDBCtemplate,template}.{query,queryForObject,queryForList,queryForMap,queryForRowSet,queryForInt,queryForLong,update,execute,batchUpdate} {entityManager,em,session}.{createQuery,createNativeQuery,createSQLQuery}
sink shell 0: Runtime.exec getRuntime().exec r.exec rt.exec runtime.exec ProcessBuilder ProcessBuilder.command pb.command exec
sink filesystem 0: File FileInputStream FileOutputStream FileReader FileWriter RandomAccessFile java.io.{File,FileInputStream,FileOutputStream,FileReader,FileWriter,RandomAccessFile} Paths.get Path.of Files.{readAllBytes,readAllLines,newInputStream,newOutputStream,newBufferedReader,write,delete,lines,copy} ZipFile PrintWriter.file
sink html 0: response.getWriter().{write,print,println,printf,format,append} resp.getWriter().{write,print,println,printf,format,append} {out,writer,pw,printWriter}.{write,print,println,printf,format,append} response.getOutputStream().{print,println,write}
sink ldap 1: {ctx,context,dirContext,idc,ldapTemplate}.search DirContext.search
sink xpath 0: {xpath,xp,xPath}.{evaluate,compile} XPath.evaluate
sink eval 0: {engine,scriptEngine}.eval ScriptEngine.eval GroovyShell.evaluate shell.evaluate
sink el 0: {parser,expressionParser}.parseExpression SpelExpressionParser.parseExpression ExpressionFactory.createValueExpression
sink xml 0: {builder,documentBuilder,db,DocumentBuilder}.parse SAXParser.parse saxParser.parse {reader,xmlReader}.parse SAXBuilder.build XMLInputFactory.createXMLStreamReader
sink deserialize 0: ObjectInputStream XMLDecoder XStream.fromXML xstream.fromXML Yaml.load yaml.load
sink redirect 0: {response,resp}.sendRedirect sendRedirect ModelAndView
sink ssrf 0: URL java.net.URL HttpGet HttpPost RestTemplate.getForObject restTemplate.{getForObject,getForEntity,postForObject,exchange} HttpRequest.newBuilder URI.create
sink header 1: {response,resp}.{setHeader,addHeader}
sink log 0: {logger,log,LOG,LOGGER}.{info,debug,warn,error,trace,severe,fine}
sink trust_boundary 1: {session,httpSession}.{setAttribute,putValue} request.getSession().{setAttribute,putValue} getSession().{setAttribute,putValue}
sink trust_boundary 0: {session,httpSession}.putName
sink regex 0: Pattern.compile
usage insecure_random: java.util.Random Random Math.random
usage csrf_disabled: csrf().disable http.csrf().disable
sanitizer html: {ESAPI.encoder(),encoder}.{encodeForHTML,encodeForHTMLAttribute,encodeForJavaScript} encodeForHTML StringEscapeUtils.{escapeHtml,escapeHtml3,escapeHtml4} HtmlUtils.htmlEscape Encode.{forHtml,forHtmlAttribute,forHtmlContent,forJavaScript} escapeHtml htmlEscape
sanitizer sql: encodeForSQL ESAPI.encoder().encodeForSQL
sanitizer ldap: encodeForLDAP encodeForDN ESAPI.encoder().{encodeForLDAP,encodeForDN}
sanitizer xpath: encodeForXPath ESAPI.encoder().encodeForXPath
sanitizer shell: encodeForOS ESAPI.encoder().encodeForOS
sanitizer redirect,ssrf,header: URLEncoder.encode encodeForURL
sanitizer filesystem: FilenameUtils.getName getCanonicalPath
sanitizer *: Integer.{parseInt,valueOf} Long.{parseLong,valueOf} Double.{parseDouble,valueOf} Boolean.{parseBoolean,valueOf} UUID.fromString length size hashCode equals equalsIgnoreCase contains startsWith endsWith matches isEmpty indexOf compareTo
""",
    "csharp": """
source user: Request.{QueryString,Query,Form,Params,Cookies,Headers,Path,Body,RawUrl,Url,UserAgent,Files,RouteValues} HttpContext.Request.{Query,Form,Cookies,Headers,Path,Body} {context,ctx}.Request.{Query,QueryString,Form,Cookies,Headers} Console.{ReadLine,Read} Request
source env: Environment.{GetEnvironmentVariable,GetCommandLineArgs}
sink sql 0: SqlCommand MySqlCommand NpgsqlCommand OracleCommand OleDbCommand SqliteCommand SqlDataAdapter {context,db,_context,_db}.Database.{ExecuteSqlRaw,ExecuteSqlCommand,SqlQuery} FromSqlRaw ExecuteSqlRaw ExecuteSqlCommand {connection,conn,db}.{Query,QueryFirst,Execute,ExecuteScalar,QueryAsync,ExecuteAsync}
sink shell 0: Process.Start ProcessStartInfo
sink filesystem 0: File.{ReadAllText,ReadAllBytes,ReadAllLines,WriteAllText,WriteAllBytes,Open,OpenRead,OpenText,Delete,Copy,Move,Create,AppendAllText,Exists} FileStream StreamReader StreamWriter Directory.{GetFiles,Delete,CreateDirectory} PhysicalFile System.IO.File.{ReadAllText,ReadAllBytes,Open,OpenRead,Delete}
sink html 0: Response.Write HtmlString MvcHtmlString Html.Raw Content Response.WriteAsync context.Response.WriteAsync
sink ldap 0: DirectorySearcher DirectoryEntry
sink xpath 0: SelectSingleNode SelectNodes XPathNavigator.{Select,Evaluate,Compile} navigator.{Select,Evaluate} XPathExpression.Compile
sink xml 0: XmlDocument.LoadXml xmlDoc.LoadXml doc.LoadXml LoadXml XmlReader.Create XDocument.Parse
sink deserialize 0: BinaryFormatter.Deserialize formatter.Deserialize JavaScriptSerializer.Deserialize NetDataContractSerializer.Deserialize LosFormatter.Deserialize SoapFormatter.Deserialize
sink redirect 0: Redirect Response.Redirect RedirectPermanent
sink ssrf 0: WebClient.{DownloadString,DownloadData} client.{GetAsync,PostAsync,GetStringAsync,DownloadString,SendAsync} HttpClient.{GetAsync,GetStringAsync} WebRequest.Create HttpWebRequest.Create
sink eval 0: CSharpScript.{EvaluateAsync,RunAsync} Assembly.Load CSharpCodeProvider.CompileAssemblyFromSource
sink log 0: {_logger,logger,log,Log}.{LogInformation,LogWarning,LogError,LogDebug,Info,Error,Warn,Debug}
sink header 1: Response.{AddHeader,AppendHeader} Response.Headers.Add
sink regex 0: Regex Regex.{IsMatch,Match,Replace,Matches}
usage weak_hash: MD5.Create SHA1.Create MD5CryptoServiceProvider SHA1CryptoServiceProvider SHA1Managed
usage weak_crypto: DES.Create TripleDES.Create RC2.Create DESCryptoServiceProvider RC2CryptoServiceProvider TripleDESCryptoServiceProvider
usage insecure_random: Random System.Random
sanitizer html: HttpUtility.{HtmlEncode,HtmlAttributeEncode,JavaScriptStringEncode} WebUtility.HtmlEncode AntiXssEncoder.HtmlEncode HtmlEncoder.Default.Encode Server.HtmlEncode Encoder.HtmlEncode
sanitizer redirect,ssrf,header: HttpUtility.UrlEncode Uri.EscapeDataString WebUtility.UrlEncode Server.UrlEncode
sanitizer filesystem: Path.GetFileName
sanitizer ldap: Encoder.{LdapFilterEncode,LdapDistinguishedNameEncode}
sanitizer xpath,xml: SecurityElement.Escape
sanitizer regex: Regex.Escape
sanitizer *: int.{Parse,TryParse} Int32.{Parse,TryParse} long.{Parse,TryParse} Convert.{ToInt32,ToInt64,ToDouble,ToBoolean} Guid.{Parse,TryParse} bool.Parse double.Parse Url.IsLocalUrl Length Count Equals Contains StartsWith EndsWith Any
""",
    "c": """
source user: getenv fgets gets fread read recv recvfrom scanf fscanf getline getc fgetc getchar argv std::cin std::getline getline cin
fills 0: fgets gets fread
fills 1: read recv recvfrom
fills +1: scanf
fills +2: fscanf sscanf
sink shell 0: system popen execl execlp execle execv execvp execve _popen _wsystem _execl ShellExecute WinExec CreateProcess std::system wordexp
sink sql 1: mysql_query mysql_real_query sqlite3_exec sqlite3_prepare sqlite3_prepare_v2 PQexec PQprepare SQLExecDirect
sink filesystem 0: fopen open openat freopen unlink remove rename chdir mkdir rmdir opendir creat stat lstat chmod chown access std::ifstream std::ofstream std::fstream std::ifstream.open ifstream ofstream CreateFile CreateFileA
sink format_string 0: printf vprintf wprintf
sink format_string 1: fprintf sprintf vfprintf vsprintf syslog fwprintf dprintf asprintf
sink format_string 2: snprintf vsnprintf
sink buffer_overflow 1: strcpy strcat wcscpy wcscat lstrcpy lstrcpyA stpcpy _mbscpy
sink buffer_overflow 2: memcpy.size memmove.size
sink alloc_size 0: malloc alloca valloc
sink alloc_size 1: calloc realloc
sink eval 0: dlopen LoadLibrary LoadLibraryA luaL_dostring
sink ldap 3: ldap_search ldap_search_s ldap_search_ext
usage dangerous_function: gets mktemp tmpnam strtok.unsafe
usage insecure_random: rand random srand drand48 std::rand
usage weak_hash: MD5 MD5_Init SHA1 SHA1_Init MD4 EVP_md5 EVP_sha1 CC_MD5
usage weak_crypto: DES_ecb_encrypt DES_set_key EVP_des_ecb EVP_rc4 RC4 DES_encrypt1
sanitizer *: atoi atol strtol strtoul strtoll isdigit isalnum strlen sizeof std::stoi abs
sanitizer filesystem: basename realpath
sanitizer sql: mysql_real_escape_string sqlite3_mprintf PQescapeLiteral
alloc malloc: malloc calloc realloc strdup strndup aligned_alloc valloc xmalloc
alloc new: new
alloc new[]: new[]
alloc fopen: fopen fdopen tmpfile freopen
alloc open: open creat
alloc popen: popen
alloc opendir: opendir
free malloc: free cfree
free new: delete
free new[]: delete[]
free fopen: fclose
free open: close
free popen: pclose
free opendir: closedir
null: malloc calloc realloc strdup strndup fopen fdopen getenv strchr strrchr strstr opendir popen strtok bsearch localtime gmtime dynamic_cast lfind
check: setuid seteuid setgid setgroups chdir chroot fscanf fread fwrite pthread_mutex_lock mkstemp ftruncate CreateMutex ImpersonateNamedPipeClient remove rename
stack 0: alloca _alloca __builtin_alloca
mode 1: chmod fchmod mkdir mkfifo creat
mode 2: open openat
mode 0: umask
copies 0,1,2: memcpy memmove strncpy wcsncpy memccpy strncat
""",
}
TABLES["typescript"] = TABLES["javascript"]
TABLES["cpp"] = TABLES["c"]


@dataclass(frozen=True, slots=True)
class Spec:
    """One row. args: the argument places that count (of `+n`, n and all after it); empty for the call itself."""

    language: str
    name: str
    role: str
    kind: str = ""
    args: tuple[int, ...] = ()
    rest: bool = False


ROLES = ("source", "sink", "usage", "sanitizer", "fills", "alloc", "free", "null", "check", "stack", "mode", "copies")


def spelled(word: str) -> list[str]:
    """{a,b} as either, from left to right."""
    m = re.search(r"\{([^{}]*)\}", word)
    return [x for part in m[1].split(",") for x in spelled(word[: m.start()] + part + word[m.end() :])] if m else [word]


def rows(language: str) -> list[Spec]:
    out = []
    for line in TABLES[language].strip().splitlines():
        head, _, body = line.partition(": ")
        words = head.split()
        role, places, kind = words[0], "", ""
        for w in words[1:]:
            if re.fullmatch(r"\+?[0-9,]+", w):
                places = w
            else:
                kind = w
        args = tuple(int(x) for x in places.lstrip("+").split(",") if x)
        out += [Spec(language, name, role, kind, args, places.startswith("+")) for word in body.split() for name in spelled(word)]
    return out


def read_rows(text: str) -> list[Spec]:
    """A user's rows: JSON lines with language, name, role and, as needed, kind, args and rest."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith(("#", "//")):
            r = json.loads(line)
            if r["role"] not in ROLES:
                raise ValueError(f"role must be one of {', '.join(ROLES)}")
            out.append(Spec(r["language"], r["name"], r["role"], r.get("kind", ""), tuple(r.get("args", ())), bool(r.get("rest"))))
    return out


class Library:
    """Rows by role and name. A callee is looked up by its whole name, then by its longest dotted suffix."""

    def __init__(self, language: str, extra: tuple[Spec, ...] = ()):
        self.by: dict[str, dict[str, Spec]] = {r: {} for r in ROLES}
        for s in [*rows(language), *(x for x in extra if x.language == language)]:
            self.by[s.role][s.name] = s

    def find(self, role: str, name: str) -> Spec | None:
        table = self.by[role]
        while name:
            if name in table:
                return table[name]
            cut = name.find(".")
            if cut < 0:
                return None
            name = name[cut + 1 :]
        return None


@cache
def library(language: str, extra: tuple[Spec, ...] = ()) -> Library:
    return Library(language, extra)


def table(spark: SparkSession, extra: tuple[Spec, ...] = ()) -> DataFrame:
    """All rows, later ones first in precedence: language, name, role, kind, args, precedence."""
    own = [(s.language, s.name, s.role, s.kind, list(s.args), 1) for lang in TABLES for s in rows(lang)]
    own += [(s.language, s.name, s.role, s.kind, list(s.args), 2) for s in extra]
    return spark.createDataFrame(own, "language string, name string, role string, kind string, args array<int>, precedence int")
