"""A small project of our own invention, on which the derivation rules are shown and tested."""

PROJECT = {
    "shop/pom.xml": """<project><groupId>dev.kiosk</groupId><artifactId>shop</artifactId><version>1.2</version><modules><module>core</module><module>web</module></modules></project>""",
    "shop/core/pom.xml": """<project><parent><groupId>dev.kiosk</groupId><artifactId>shop</artifactId><version>1.2</version></parent><artifactId>core</artifactId>
<properties><db.version>9.1</db.version></properties>
<dependencies><dependency><groupId>org.sample</groupId><artifactId>driver</artifactId><version>${db.version}</version><scope>runtime</scope></dependency></dependencies></project>""",
    "shop/web/pom.xml": """<project><parent><groupId>dev.kiosk</groupId><artifactId>shop</artifactId><version>1.2</version></parent><artifactId>web</artifactId>
<dependencies><dependency><groupId>dev.kiosk</groupId><artifactId>core</artifactId><version>${project.version}</version></dependency></dependencies></project>""",
    "shop/core/src/main/java/dev/kiosk/core/Basket.java": """package dev.kiosk.core;
import jakarta.persistence.*;
import java.util.List;
@Entity @Table(name = "baskets")
public class Basket {
    @Id private Long id;
    @OneToMany(mappedBy = "basket") private List<Line> lines;
    @ManyToOne private Basket parent;
}
""",
    "shop/core/src/main/java/dev/kiosk/core/Line.java": """package dev.kiosk.core;
import jakarta.persistence.*;
@Entity
public class Line {
    @Id private Long id;
    @ManyToOne private Basket basket;
}
""",
    "shop/core/src/main/java/dev/kiosk/core/BasketRepository.java": """package dev.kiosk.core;
import org.springframework.data.jpa.repository.JpaRepository;
public interface BasketRepository extends JpaRepository<Basket, Long> {
    Basket findByOwnerNameAndOpenTrueOrderByIdDesc(String ownerName);
}
""",
    "shop/core/src/main/java/dev/kiosk/core/Pricing.java": """package dev.kiosk.core;
/** Prices of baskets. */
public interface Pricing {
    long total(Basket basket);
}
""",
    "shop/core/src/main/java/dev/kiosk/core/FlatPricing.java": """package dev.kiosk.core;
import org.springframework.stereotype.Service;
import org.springframework.transaction.annotation.Transactional;
@Service
public class FlatPricing implements Pricing {
    @Value("${shop.rate:5}") private int rate;
    /** Rate times the number of lines. */
    @Transactional
    public long total(Basket basket) { return rate * count(basket); }
    private long count(Basket basket) { return 1; }
}
""",
    "shop/web/src/main/java/dev/kiosk/web/BasketController.java": """package dev.kiosk.web;
import dev.kiosk.core.Basket;
import dev.kiosk.core.Pricing;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping("/baskets")
public class BasketController {
    private final Pricing pricing;
    public BasketController(Pricing pricing) { this.pricing = pricing; }
    @GetMapping("/{id}")
    public Basket show(@PathVariable Long id) { return null; }
    @PostMapping(consumes = "application/json")
    public long price(@RequestBody Basket basket) { return pricing.total(basket); }
}
""",
    "shop/web/src/main/java/dev/kiosk/web/BasketClient.java": """package dev.kiosk.web;
import org.springframework.cloud.openfeign.FeignClient;
@FeignClient(name = "shop", path = "/baskets")
public interface BasketClient {
    @GetMapping("/{basketId}/")
    Object fetch(Long basketId);
}
""",
    "shop/web/src/main/java/dev/kiosk/web/Wiring.java": """package dev.kiosk.web;
import java.util.List;
import org.springframework.context.annotation.*;
@Configuration
public class Wiring {
    @Autowired private List<Pricing> all;
    @Autowired private Clock clock;
    @Bean("timer") public Clock systemClock() { return null; }
    @Bean public Clock spareClock() { return null; }
}
""",
    "shop/web/src/main/java/dev/kiosk/web/Audit.java": """package dev.kiosk.web;
@Aspect
@Component
public class Audit {
    @Pointcut("execution(* dev.kiosk.core..*.total(..))") public void totals() {}
    @Around("totals() || @annotation(org.springframework.web.bind.annotation.GetMapping)") public Object watch(Object call) { return null; }
    @KafkaListener(topics = {"orders", "returns"}) public void on(String message) {}
}
""",
    "shop/web/src/main/resources/application.properties": "shop.rate=7\nshop.token=hidden\n",
    "shop/core/db/schema.sql": "CREATE TABLE store.baskets (id bigint PRIMARY KEY, owner_id bigint REFERENCES store.owners (id));\nCREATE TABLE store.owners (id bigint PRIMARY KEY, name text NOT NULL);\n",
    "shop/core/src/main/resources/PricingMapper.xml": """<mapper namespace="dev.kiosk.core.Pricing"><sql id="cols">id, rate</sql>
<select id="total">SELECT <include refid="cols"/> FROM store.rates WHERE note = 'from nowhere'</select></mapper>""",
    "shop/web/src/main/resources/routes.xml": """<routes><route id="restock"><from uri="direct:restock"/><choice><when><simple>${body} == 1</simple><to uri="jms:few"/></when>
<otherwise><to uri="jms:many"/></otherwise></choice><bean ref="flatPricing" method="total"/><to uri="log:done"/></route></routes>""",
}
